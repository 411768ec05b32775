"""Near copies by order MinHash, verified by banded alignment.

A sketch takes the ``PICKS`` smallest of a text's word k-mers, each labelled with its
occurrence, under one hash order and keeps them in the order of the text. Texts
with small edit distance share many sketches; shuffled texts do not. Texts that share a sketch
are aligned with the leader of their bucket, so a bucket of like texts gives no more pairs than it
has texts. Where this leaves a bucket in several classes, all its pairs across classes meet: bits of their words
rule out most, the others are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm.common import bounded_batches, numbered, parallelism, table, text_of
from priceloom.llm.graph import components
from priceloom.llm.tokens import C1, edit_distance, kmers, mix, together, word_hashes

# At edit similarity 0.8 half of the 3-mers are kept, so that 48 sketches of two miss a pair with a chance of about 0.003.
K = 3
SKETCHES = 48
PICKS = 2
# Bits that tell the words of a text, and texts of a bucket that meet in one tile.
BITS = 4096
TILE = 1024
# Words of a block, about: longer texts make smaller blocks.
TILE_WORDS = 1 << 20
# Pairs of two classes that a tile aligns in the first round, and the factor of each further round.
FIRST_PAIRS = 32
MORE_PAIRS = 64
#: Edit similarity from which two texts are linked: 1 - word edits / words of the longer one.
SIMILARITY = 0.8
# Places of k-mers within a text: more than a text of 2 GB has.
_PLACE_BITS = np.uint64(32)
_TOP = np.uint64(2**64 - 1)


def sketches(words: np.ndarray, counts: np.ndarray, k: int = K, number: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """Order MinHash of every text (texts x sketches) from the hashed words of all texts one after another.

    A text of fewer than k words is one k-mer of all its words. Smallest k-mers are found by
    their upper hash bits, equal ones by their place.
    """
    out = np.zeros((len(counts), number), dtype=np.uint64)
    full = np.nonzero(counts >= k)[0]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    for i in np.nonzero((counts > 0) & (counts < k))[0]:
        h = np.array([counts[i]], dtype=np.uint64)
        for w in words[starts[i]:starts[i] + counts[i]]:
            h = mix(h * C1 + w)
        out[i] = mix(np.arange(1, number + 1, dtype=np.uint64) * C1 + h)
    if not len(full):
        return out
    n = counts[full] - k + 1
    text = np.repeat(np.arange(len(full)), n)
    begins = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(n.sum()) - begins[text]
    gram = kmers(words, k)[starts[full][text] + place]
    # occurrence labels: the how manieth of its kind a k-mer is within its text
    keyed = mix(gram + text.astype(np.uint64) * C1)
    order = np.argsort(keyed, kind="stable")
    new = np.concatenate([[True], keyed[order][1:] != keyed[order][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    nth = np.empty(len(order), dtype=np.uint64)
    nth[order] = (np.arange(len(order)) - first).astype(np.uint64)
    label = mix(gram + nth * C1)
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    low = place.astype(np.uint64) & mask
    seeds = np.arange(1, number + 1, dtype=np.uint64) * C1
    for s in range(number):
        ranked = (mix(label + seeds[s]) & ~mask) | low
        chosen = np.full((len(full), picks), _TOP, dtype=np.uint64)
        for p in range(min(picks, int(n.max()))):
            least = np.minimum.reduceat(ranked, begins)
            chosen[:, p] = least
            some = least != _TOP
            ranked[(begins + (least & mask).astype(np.int64))[some]] = _TOP
        at = np.where(chosen == _TOP, np.uint64(0), chosen & mask).astype(np.int64)
        missing = chosen == _TOP
        at[missing] = n.max() + 1
        at.sort(axis=1)  # the order of the text
        sig = np.full(len(full), s + 1, dtype=np.uint64)
        for p in range(picks):
            there = at[:, p] <= n.max()
            value = label[np.where(there, begins + at[:, p], 0)]
            sig = mix(sig * C1 + np.where(there, value, np.uint64(p)))
        out[full, s] = sig
    return out


def word_bits(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One bit of ``BITS`` turned over by every word with its occurrence, a row per text: no more bits differ than words do."""
    text = np.repeat(np.arange(len(counts)), counts)
    keyed = mix(words + text.astype(np.uint64) * C1)
    order = np.argsort(keyed, kind="stable")
    new = np.concatenate([[True], keyed[order][1:] != keyed[order][:-1]])[:len(order)]
    nth = np.empty(len(order), dtype=np.uint64)
    nth[order] = (np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))).astype(np.uint64)
    place = mix(words + nth * C1) % np.uint64(BITS)
    out = np.zeros((len(counts), BITS // 64), dtype=np.uint64)
    np.bitwise_xor.at(out, (text, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return out


def may_match(bits: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the ``others`` may be similar enough to text i: an edit changes at most two words, and one if it changes the length."""
    longer = np.abs(sizes[others] - sizes[i])
    limit = np.floor((1 - similarity) * np.maximum(sizes[i], sizes[others]) + 1e-9)
    some = longer <= limit
    others, longer, limit = others[some], longer[some], limit[some]
    apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
    return others[apart + longer <= 2 * limit]


_TILE = ["s", "bucket", "i", "j", "block", "a", "root", "words"]


def _by_tile(tiled: DataFrame, of, ddl: str) -> DataFrame:
    """``of`` (ints as ``_TILE``, lists of the further columns) of the rows of whole tiles together, in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ints = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(len(_TILE))], axis=1)
            more = [batch.column(c).to_pylist() for c in range(len(_TILE), batch.num_columns)]
            if held is not None:
                ints, more = np.concatenate([held[0], ints]), [x + y for x, y in zip(held[1], more)]
            # the last tile may go on in the next batch
            whole = int(np.argmax((ints[:, :4] == ints[-1:, :4]).all(axis=1))) if len(ints) else 0
            if whole:
                yield of(ints[:whole], [x[:whole] for x in more])
            held = ints[whole:], [x[whole:] for x in more]
        if held is not None and len(held[0]):
            yield of(*held)

    key = _TILE[:4]
    return tiled.repartition(parallelism(tiled.sparkSession), *key).sortWithinPartitions(*key).mapInArrow(run, ddl)


def _candidates(ints: np.ndarray, bits: np.ndarray, similarity: float):
    """Places (first, others) of the texts of one tile that are in different classes and may match."""
    edges = np.append(np.nonzero(np.concatenate([[True], (ints[1:, :4] != ints[:-1, :4]).any(axis=1)]))[0], len(ints))
    block, root, words = ints[:, 4], ints[:, 6], ints[:, 7]
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        one = ints[s, 2] == ints[s, 3]
        for i in range(s, e):
            others = np.arange(i + 1, e)
            others = others[(root[others] != root[i]) & (True if one else block[others] != block[i])]
            if len(others):
                yield s, i, may_match(bits, words, i, others, similarity)


def _tile_texts(members: DataFrame, profile: DataFrame, similarity: float) -> DataFrame:
    """Texts (``_TILE``) of ``members`` (a, words, s, bucket, root) that may match one of another class in their tile.

    A bucket is cut into blocks of bounded rows and words; every two blocks meet in a tile of their own, so a bucket of any
    size is no hot task. ``profile`` has _a and bits.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("words") / TILE_WORDS)).cast("int")
    sizes = members.groupBy("s", "bucket").agg(blocks.alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    # of two texts, one is the leader that the other has met
    open_ = settle(sizes.where("lo <> hi and n > 2").select("s", "bucket", "blocks"), "open-buckets")
    block = F.pmod(F.xxhash64("a", F.lit("block")), F.col("blocks")).cast("int")
    placed = members.join(open_, ["s", "bucket"]).select("a", "root", "words", F.struct("s", "bucket", "blocks", block.alias("block")).alias("tile"))
    # a text meets its bits once, whatever the number of its buckets; a sketch of a text is one row
    once = placed.groupBy("a").agg(F.first("root").alias("root"), F.first("words").alias("words"), F.collect_list("tile").alias("tiles"))
    each = once.join(profile, F.col("a") == F.col("_a")).select("a", "root", "words", "bits", F.explode("tiles").alias("tile")).select("a", "root", "words", "bits", "tile.*")
    tiled = each.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("s", "bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "a", "root", "words", "bits")

    def of(ints, more):
        bits = np.frombuffer(b"".join(more[0]), np.uint64).reshape(-1, BITS // 64)
        some = np.zeros(len(ints), bool)
        for _, i, others in _candidates(ints, bits, similarity):
            some[others] = True
            some[i] |= len(others) > 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in ints[some].T], names=_TILE)

    return _by_tile(tiled, of, ", ".join(f"{c} long" for c in _TILE))


def _tile_links(tiled: DataFrame, profile: DataFrame, similarity: float, done: int, upto: int) -> DataFrame:
    """Links (a, b; a > b) of the texts ``tiled`` (``_TILE``) that join different classes.

    ``profile`` has _a, bits, sigs and hashes (of the words). A pair belongs to the first sketch that its texts share. Of
    the pairs between two classes that may match, a tile aligns those from number ``done`` to ``upto`` in the order of a hash,
    until a link joins the two; only links come out, fewer than the tile has rows, and a row of -1 if pairs are left. As
    classes only grow, a pair before ``done`` was among the first of its classes in an earlier round.
    """
    # a text meets its words once, whatever the number of its tiles
    tiles = tiled.groupBy("a").agg(F.collect_list(F.struct(*_TILE)).alias("tiles"))
    wanted = settle(tiles.select(F.col("a").alias("_w"), "tiles"), "open-texts")
    full = profile.join(wanted.hint("shuffle_hash"), F.col("_a") == F.col("_w")).select(F.explode("tiles").alias("tile"), "bits", "sigs", "hashes").select("tile.*", "bits", "sigs", "hashes")

    def linked(pairs, hashes):
        """Those of the pairs (a, b, smaller and larger root, both places) that join classes, and what finds the class of a root then."""
        class_of: dict[int, int] = {}

        def find(r):
            while class_of.get(r, r) != r:
                r = class_of[r]
            return r

        out = []
        for a, b, lo, hi, x, y in pairs.T.tolist():
            lo, hi = find(lo), find(hi)
            if lo != hi:
                x, y = np.frombuffer(hashes[x], np.uint64), np.frombuffer(hashes[y], np.uint64)
                limit = int(np.floor((1 - similarity) * max(len(x), len(y)) + 1e-9))
                if edit_distance(x, y, limit) <= limit:
                    class_of[max(lo, hi)] = min(lo, hi)
                    out.append((a, b))
        return out, find

    def of(ints, more):
        bits, sigs, hashes = np.frombuffer(b"".join(more[0]), np.uint64).reshape(-1, BITS // 64), np.array(more[1], np.int64), more[2]
        a, root, tiles, links = ints[:, 5], ints[:, 6], {}, []
        for start, i, others in _candidates(ints, bits, similarity):
            others = others[~(sigs[others, :ints[i, 0]] == sigs[i, :ints[i, 0]]).any(axis=1)]
            first = np.full(len(others), i)
            tiles.setdefault(start, []).append(np.stack([
                np.maximum(a[i], a[others]), np.minimum(a[i], a[others]), np.minimum(root[i], root[others]), np.maximum(root[i], root[others]), first, others,
            ]))
        for found in tiles.values():
            pairs = np.concatenate(found, axis=1)
            pairs = pairs[:, np.lexsort([mix(pairs[0].astype(np.uint64) * C1 + pairs[1].astype(np.uint64)), pairs[3], pairs[2]])]
            new = np.concatenate([[True], (pairs[2:4, 1:] != pairs[2:4, :-1]).any(axis=0)])[:pairs.shape[1]]
            nth = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            joined, find = linked(pairs[:, (nth >= done) & (nth < upto)], hashes)
            links += joined
            # the first pair after those stands for the rest of its two classes
            if any(find(lo) != find(hi) for lo, hi in pairs[2:4, nth == upto].T.tolist()):
                links.append((-1, -1))
        links = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return _by_tile(full, of, "a long, b long").distinct()


def _sketch_rows(docs: DataFrame) -> DataFrame:
    """Per row: _row, doc_id, key1, key2 (hash of all words), sigs, words (number), bits."""
    schema = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("sigs", pa.list_(pa.int64())),
                        ("words", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for part in together(texts, 2 << 20):
                words, counts = word_hashes(texts[part])
                sigs = sketches(words, counts).view(np.int64)
                ends = np.cumsum(counts)
                raw = [words[e - c:e].tobytes() for e, c in zip(ends, counts)]
                keys = np.array([divmod(xxhash.xxh3_128_intdigest(r), 1 << 64) for r in raw], dtype=np.uint64).view(np.int64).reshape(-1, 2)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, sigs.shape[1]), pa.int32()), pa.array(sigs.ravel()))
                bits = [b.tobytes() for b in word_bits(words, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], pa.array(keys[:, 0]), pa.array(keys[:, 1]), flat, pa.array(counts), pa.array(bits, type=pa.binary())],
                    schema=schema,
                )

    return docs.select("_row", F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "_row long, doc_id long, key1 long, key2 long, sigs array<long>, words long, bits binary"
    )


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hashed words (bytes) of the rows in ``wanted`` (a: row number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for part in together(texts, 4 << 20):
                words, counts = word_hashes(texts[part])
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array([words[e - c:e].tobytes() for e, c in zip(ends, counts)], type=pa.binary())],
                    names=["_row", "words"],
                )

    rows = docs.select("_row", text_of().alias("text")).join(wanted.select("a").hint("shuffle_hash"), F.col("_row") == F.col("a"), "left_semi")
    return rows.mapInArrow(run, "_row long, words binary")


def _pair_words(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hashed words of all texts in the ``pairs`` (a, b), written."""
    needed = settle(pairs.select("a").union(pairs.select("b")).distinct(), "needed")
    return settle(_words_of(docs, needed), "pair-words")


def _similar(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) with ``ok``: whether their alignment is similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                limit = int(np.floor((1 - similarity) * max(len(x), len(y)) + 1e-9))
                ok.append(edit_distance(x, y, limit) <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], schema=schema)

    one = words.select(F.col("_row").alias("a"), F.col("words").alias("wa"))
    two = words.select(F.col("_row").alias("b"), F.col("words").alias("wb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, ok boolean")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of texts in different classes (``roots``: node, root), each once."""
    one = roots.select(F.col("node").alias("_na"), F.col("root").alias("_ra"))
    two = roots.select(F.col("node").alias("_nb"), F.col("root").alias("_rb"))
    placed = pairs.join(one, F.col("a") == F.col("_na"), "left").join(two, F.col("b") == F.col("_nb"), "left")
    return placed.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _joined(roots: DataFrame | None, judged: DataFrame) -> DataFrame:
    """Classes (node, root) of the former ``roots`` and of the pairs ``judged`` (a, b, ok) alike."""
    links = settle(judged.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v")), "judged")
    if roots is not None:
        if links.isEmpty():
            return roots
        # classes so far are links of their roots
        links = links.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return settle(components(links), "roots")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, and _row, _root (row numbers).

    ``docs`` (doc_id, text) must be a table read. Texts with equal words are one class; different texts are linked
    if they share a sketch and their edit similarity is at least
    ``similarity``; classes are the connected components. All texts of a bucket meet its leader, its first text
    in the order of a hash, and then all texts of the bucket that are not yet in their class.
    Null and blank texts are one class; repeated rows are copies; null ids are the smallest; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    placed = numbered(docs.select("doc_id", "text")).select("_row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    rows = settle(_sketch_rows(placed), "order-sketches")
    texts = settle(
        rows.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "_row", "sigs", "words", "bits")).alias("r")).select(
            "key1", "key2", F.col("r._row").alias("a"), "r.sigs", "r.words", "r.bits"
        ),
        "distinct-texts",
    )
    waiting = texts.where(F.element_at("sigs", 1) != 0).select("a", "words", F.posexplode("sigs").alias("s", "bucket"))
    # one order of texts for all buckets, so that a group has few leaders
    lead = F.struct(F.xxhash64("a", F.lit(0)).alias("h"), "a")
    buckets = waiting.groupBy("s", "bucket").agg(F.min(lead).alias("x"), F.max(lead).alias("y")).where("x <> y")
    shared = settle(waiting.join(buckets.select("s", "bucket", F.col("x.a").alias("b")), ["s", "bucket"]), "buckets")
    met = settle(shared.where("a <> b").select("a", "b").distinct(), "meetings")
    # every text of a shared bucket meets its leader, so that these are the words of all texts below
    words = _pair_words(placed, met)
    # each text meets the first of its leaders, then those that are not yet in its class
    first = met.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(0)).alias("h"), "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    roots = _joined(None, _similar(first, words, similarity))
    roots = _joined(roots, _similar(_apart(met, roots), words, similarity))
    # whoever is not yet in one class with all others of its bucket meets the other classes, some pairs of two classes
    # at a time: classes that merge need no more
    profile = texts.select(F.col("a").alias("_a"), "bits", "sigs")
    whole = profile.join(words.select("_row", F.col("words").alias("hashes")), F.col("_a") == F.col("_row")).drop("_row")
    done, upto = 0, FIRST_PAIRS
    while True:
        members = shared.select("a", "words", "s", "bucket").join(roots, F.col("a") == F.col("node"), "left").select("a", "words", "s", "bucket", F.coalesce("root", "a").alias("root"))
        tiled = settle(_tile_texts(settle(members, "bucket-members"), profile.select("_a", "bits"), similarity), "tile-texts")
        more = settle(_tile_links(tiled, whole, similarity, done, upto), "further-pairs")
        roots = _joined(roots, more.where("a >= 0").withColumn("ok", F.lit(True)))
        if more.where("a < 0").isEmpty():
            break
        done, upto = upto, upto * MORE_PAIRS
    classes = texts.select("key1", "key2", "a").join(roots, F.col("a") == F.col("node"), "left").select(
        F.col("key1").alias("_k1"), F.col("key2").alias("_k2"), F.coalesce("root", "a").alias("_set")
    )
    member = settle(
        rows.select("_row", "doc_id", "key1", "key2").join(classes, (F.col("key1") == F.col("_k1")) & (F.col("key2") == F.col("_k2")))
        .select("_row", "doc_id", "_set"), "members",
    )
    heads = member.groupBy(F.col("_set").alias("_of")).agg(F.min(F.struct("doc_id", "_row")).alias("h"), F.count(F.lit(1)).alias("class_size"))
    return member.join(heads, F.col("_set") == F.col("_of")).select(
        "doc_id", F.col("h.doc_id").alias("class_id"), "class_size", "_row", F.col("h._row").alias("_root")
    )


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy class of every document."""
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of every class stays, that with the smallest doc_id."""
    keep = settle(near_copies(docs).where(F.col("_row") == F.col("_root")).select(F.col("_row").alias("_keep")), "kept-rows")
    return numbered(docs).join(keep.hint("shuffle_hash"), F.col("_row") == F.col("_keep"), "left_semi").select(
        *[F.col("doc").getField(c).alias(c) for c in docs.columns]
    )
