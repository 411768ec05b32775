"""Repeated passages by collinear chaining of shared k-mer seeds.

Seeds are word k-mers whose hash is a multiple of ``SHARE``: whether a k-mer is one hangs on its own words only, so every
equal run of k words is a seed in both texts or in neither, whatever is changed beside it. A seed is joined with its first
occurrence in the corpus, never with all others, so a passage of any number of copies gives as many anchors
as it has copies. Anchors of a pair of documents are chained with a gap cost through a Fenwick tree;
chains are then aligned on the words, and their maximal pieces that are similar enough, extended at both ends, are kept if long enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm.common import bounded_batches, forget, numbered, parallelism, release, table, text_of
from priceloom.llm.tokens import edit_distance, kmers, together, word_hashes

# Words of a seed: at identity 0.8 with every fifth word changed, runs of four equal words are left.
K = 4
# One k-mer of so many is a seed.
SHARE = 3
#: Least words of a passage and least identity: 1 - word edits / words.
PASSAGE = 50
IDENTITY = 0.8
# Cost of a word skipped on either side between two chained segments.
GAP_COST = 0.05
# Seeds of one diagonal whose places differ by at most this many words make one segment.
NEAR = 16
# Words around a chain that are looked at when it is extended.
MARGIN = 64
# Equal words that must follow a skipped one.
RESUME = 4
# Seeds meet and chains are aligned in so many parts, one after another, so that one part alone is shuffled at a time.
PARTS = 4


def seeds(words: np.ndarray, counts: np.ndarray, k: int = K, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and hash of every k-mer of its text that is a seed."""
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    gram = kmers(words, k)
    chosen = np.flatnonzero((gram % np.uint64(share) == 0) & (np.arange(len(words)) + k <= starts[1:][text]))
    return text[chosen], chosen - starts[text[chosen]], gram[chosen]


def _seed_rows(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("seed", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for part in together(texts, 2 << 20):
                text, place, gram = seeds(*word_hashes(texts[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(rows[part][text]), pa.array(place.astype(np.int32))], schema=schema
                )

    return docs.select("_row", text_of().alias("text")).mapInArrow(run, "seed long, row long, pos int")


class Fenwick:
    """Largest value among the first places."""

    def __init__(self, size: int):
        self.best = [(-np.inf, -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]):
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def top(self, place: int) -> tuple[float, int]:
        """Over places before ``place``."""
        found = (-np.inf, -1)
        while place > 0:
            if self.best[place] > found:
                found = self.best[place]
            place -= place & -place
        return found


def chain(segments: list[tuple[int, int, int]], k: int = 6, gap_cost: float = 0.2) -> list[list[int]]:
    """Best chains of segments (x, length, y): x, y their first words in both texts, lengths in words.

    A segment may follow another if it starts after the other's last seed on both sides; a chain
    scores the words of its segments less ``gap_cost`` per word skipped on either side. Starts are
    asked and ends are posted in order of x, the best end before y comes from a Fenwick tree. Chains
    are taken from the best end down, each segment once.
    """
    lasts = [(x + n - k + 1, y + n - k + 1) for x, n, y in segments]
    columns = sorted({y for _, y in lasts})
    rank = {y: i for i, y in enumerate(columns)}
    events = sorted([(x, 1, i) for i, (x, _, _) in enumerate(segments)] + [(lasts[i][0], 0, i) for i in range(len(segments))])
    tree = Fenwick(len(columns))
    score, before = [0.0] * len(segments), [-1] * len(segments)
    for at, starts, i in events:
        x, n, y = segments[i]
        if starts:
            score[i] = float(n)
            value, j = tree.top(int(np.searchsorted(columns, y, side="right")))
            if j >= 0:
                gain = value - gap_cost * (x + y)
                if gain > 0:
                    score[i], before[i] = n + gain, j
        else:
            tree.put(rank[lasts[i][1]], (score[i] + gap_cost * (lasts[i][0] + lasts[i][1]), i))
    taken, out = [False] * len(segments), []
    for i in sorted(range(len(segments)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not taken[i]:
            taken[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(path[::-1])
    return out


def _chains(anchors: DataFrame) -> DataFrame:
    """Chains of all pairs of documents: row, crow, x0, x1, y0, y1, xs, ns, ys (segments)."""
    schema = pa.schema([(c, pa.int64()) for c in ("row", "crow", "x0", "x1", "y0", "y1")] + [(c, pa.list_(pa.int32())) for c in ("xs", "ns", "ys")])

    def of(row, crow, pos, cpos):
        """``anchors`` in order of row, crow, diagonal, pos."""
        diagonal = pos - cpos
        pair = np.concatenate([[True], (row[1:] != row[:-1]) | (crow[1:] != crow[:-1])])
        cut = pair | np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > NEAR)])
        first = np.nonzero(cut)[0]
        last = np.append(first[1:], len(row)) - 1
        x, y, n = pos[first], cpos[first], pos[last] - pos[first] + K
        group = np.cumsum(pair)[first]
        edges = np.append(np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0], len(first))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            found = [[0]] if b - a == 1 else chain([(int(x[i]), int(n[i]), int(y[i])) for i in range(a, b)], K, GAP_COST)
            for path in found:
                p = [a + i for i in path]
                x0, x1, y0, y1 = x[p[0]], x[p[-1]] + n[p[-1]], y[p[0]], y[p[-1]] + n[p[-1]]
                out.append((row[first[a]], crow[first[a]], x0, x1, y0, y1, x[p], n[p], y[p]))
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy().astype(np.int64) for c in range(4)]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now)]
            if not len(now[0]):
                continue
            # the last document may go on in the next batch
            whole = int(np.searchsorted(now[0] == now[0][-1], True))
            if whole:
                done = of(*[c[:whole] for c in now])
                if done is not None:
                    yield done
            held = [c[whole:] for c in now]
        if held is not None and len(held[0]):
            done = of(*held)
            if done is not None:
                yield done

    ddl = "row long, crow long, x0 long, x1 long, y0 long, y1 long, xs array<int>, ns array<int>, ys array<int>"
    ordered = anchors.repartition(parallelism(anchors.sparkSession), "row").sortWithinPartitions("row", "crow", F.col("pos") - F.col("cpos"), "pos")
    return ordered.select("row", "crow", "pos", "cpos").mapInArrow(run, ddl)


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Words of the ``wanted`` windows (part, side, r, lo, hi) as 32 bits of their hashes: part, side, r, lo, hi, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            asked = batch.column(2)
            ends = np.cumsum(asked.value_lengths().to_numpy())
            part_, side, lo, hi = (x.to_numpy() for x in asked.flatten().flatten())
            text = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
            for part in together(texts, 4 << 20):
                words, counts = word_hashes(texts[part])
                raw = words.astype(np.uint32).tobytes()
                starts = np.concatenate([[0], np.cumsum(counts)])
                first, last = int(ends[part.start - 1]) if part.start else 0, int(ends[part.stop - 1])
                for at in range(first, last, 4096):
                    now = slice(at, min(at + 4096, last))
                    of = text[now] - part.start
                    begin = 4 * (starts[of] + lo[now])
                    end = 4 * np.minimum(starts[of] + hi[now], starts[of + 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part_[now]), pa.array(side[now]), pa.array(rows[text[now]]), pa.array(lo[now]), pa.array(hi[now]),
                         pa.array([raw[s:e] for s, e in zip(begin.tolist(), end.tolist())], type=pa.binary())],
                        names=["part", "side", "r", "lo", "hi", "words"],
                    )

    lists = settle(wanted.distinct().groupBy("r").agg(F.collect_list(F.struct("part", "side", "lo", "hi")).alias("asked")), "asked")
    joined = docs.select("_row", text_of().alias("text")).join(lists.hint("shuffle_hash"), F.col("_row") == F.col("r"))
    return joined.select("_row", "text", "asked").mapInArrow(run, "part int, side int, r long, lo long, hi long, words binary")


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far equal words go from the start of both, over single edits that ``RESUME`` equal words follow: words of a, of b, edits."""
    i = j = edits = 0
    while True:
        n = min(len(a) - i, len(b) - j)
        if n <= 0:
            return i, j, edits
        if a[i] == b[j]:
            differ = a[i:i + n] != b[j:j + n]
            run = int(differ.argmax()) if differ.any() else n
            i, j = i + run, j + run
        for p, q in ((1, 1), (1, 0), (0, 1)):
            x, y = i + p, j + q
            # most differ in their first word already
            if x + RESUME <= len(a) and y + RESUME <= len(b) and a[x] == b[y] and (a[x:x + RESUME] == b[y:y + RESUME]).all():
                i, j, edits = i + p, j + q, edits + 1
                break
        else:
            return i, j, edits


def align(a: np.ndarray, b: np.ndarray, xs, ns, ys, identity: float = IDENTITY) -> list[tuple[int, int, int, int, float]]:
    """Align a chain on the words: first and end place in both texts and identity of its maximal pieces of that identity.

    A piece goes from one run of equal words of the chain to a later one and is extended at both ends, at most to the
    neighbouring runs. Pieces may overlap, none lies within another.
    """
    runs, edits, end_x, end_y = [], [0], 0, 0  # runs of equal words; edits before each
    for x, n, y in zip(xs, ns, ys):
        # seeds of two segments may share words; the later one gives way
        shift = max(end_x - x, end_y - y, 0) if runs else 0
        x, y, n = x + shift, y + shift, n - shift
        if n <= 0:
            continue
        same = a[x:x + n] == b[y:y + n]
        bounds = [0, len(same)] if same.all() else np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]))).tolist()
        for s, e in zip(bounds[::2], bounds[1::2]):
            if runs:
                p, q = a[end_x:x + s], b[end_y:y + s]
                edits.append(edits[-1] + edit_distance(p, q, max(len(p), len(q))))
            runs.append((x + s, x + e, y + s, y + e))
            end_x, end_y = x + e, y + e
    if not runs:
        return []
    if len(runs) == 1:
        (x0, x1, y0, y1), = runs
        back, on = _extend(a[:x0][::-1], b[:y0][::-1]), _extend(a[x1:], b[y1:])
        x0, y0, x1, y1, found = x0 - back[0], y0 - back[1], x1 + on[0], y1 + on[1], back[2] + on[2]
        if found > (1 - identity) * max(x1 - x0, y1 - y0) + 1e-9:
            return []
        return [(x0, x1, y0, y1, 1 - found / max(x1 - x0, y1 - y0))]
    edits = np.array(edits)
    x0, x1, y0, y1 = np.array(runs).T
    back = [_extend(a[i:j][::-1], b[p:q][::-1]) for i, j, p, q in zip([0, *x1[:-1]], x0, [0, *y1[:-1]], y0)]
    on = [_extend(a[i:j], b[p:q]) for i, j, p, q in zip(x1, [*x0[1:], len(a)], y1, [*y0[1:], len(b)])]
    back, on = np.array(back).T, np.array(on).T
    x0, y0, before = x0 - back[0], y0 - back[1], edits - back[2]
    x1, y1, after = x1 + on[0], y1 + on[1], edits + on[2]
    # a piece from i to j is similar if its edits are few for its words on either side; the last such j of every i
    last = np.full(len(runs), -1)
    for start, end in ((x0, x1), (y0, y1)):
        value = (1 - identity) * end - after
        best = np.maximum.accumulate(value[::-1])[::-1]  # falls with j
        need = (1 - identity) * start - before - 1e-9
        last = np.maximum(last, np.searchsorted(-best, -need, side="right") - 1)
    out, reached = [], -1
    for i, j in enumerate(last.tolist()):
        if j >= i and j > reached:
            reached = j
            words = max(x1[j] - x0[i], y1[j] - y0[i])
            out.append((int(x0[i]), int(x1[j]), int(y0[i]), int(y1[j]), float(1 - (after[j] - before[i]) / words)))
    return out


def passages(docs: DataFrame, least: int = PASSAGE, identity: float = IDENTITY) -> DataFrame:
    """Passages that repeat one of an earlier document.

    ``docs`` (doc_id, text) must be a table read. Returns doc_id, start, end (words), source_id, source_start, source_end,
    identity, and _row. The source is the first document in the order of the table in which the
    seeds of the passage occur, and is not itself reported for it. Passages of one document may
    overlap when parts have different sources. Null and short texts have none; repeated rows
    repeat all their words; other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    placed = numbered(docs.select("doc_id", "text")).select("_row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    ids = settle(placed.select("_row", "doc_id"), "row-ids")
    found = settle(_seed_rows(placed), "seeds")
    # seeds meet in parts, one after another, so that the seeds of one part alone are shuffled at a time
    anchors = []
    for part in range(PARTS):
        mine = found.where(F.pmod("seed", F.lit(PARTS)) == part)
        # written, so that the join deals both sides anew and a seed of very many texts is split
        source = settle(
            mine.groupBy("seed").agg(F.min(F.struct("row", "pos")).alias("c"), F.max("row").alias("other"))
            .where(F.col("c.row") != F.col("other")).select("seed", F.col("c.row").alias("crow"), F.col("c.pos").alias("cpos")),
            "seed-sources",
        )
        release(docs.sparkSession)
        anchors.append(settle(mine.join(source.hint("shuffle_hash"), "seed").where("row <> crow").select("row", "crow", "pos", "cpos"), "anchors"))
        forget(source)
        del mine, source
        release(docs.sparkSession)
    forget(found)
    written = settle(_chains(reduce(DataFrame.union, anchors)), "chains")
    for one in anchors:
        forget(one)
    del anchors, found, one
    release(docs.sparkSession)
    chains = written.select(
        "*", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int").alias("part"), F.greatest(F.col("x0") - MARGIN, F.lit(0)).alias("xa"), (F.col("x1") + MARGIN).alias("xb"),
        F.greatest(F.col("y0") - MARGIN, F.lit(0)).alias("ya"), (F.col("y1") + MARGIN).alias("yb"),
    )
    # the sides are kept apart, so that each is shuffled only for its own join
    wanted = chains.select("part", F.lit(0).alias("side"), F.col("row").alias("r"), F.col("xa").alias("lo"), F.col("xb").alias("hi")).union(
        chains.select("part", F.lit(1), "crow", "ya", "yb")
    )
    windows = settle(_windows(placed, wanted), "windows")
    del wanted
    release(docs.sparkSession)
    schema = pa.schema([(c, pa.int64()) for c in ("row", "crow", "start", "end", "source_start", "source_end")] + [("identity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, crow, xa, ya, xs, ns, ys, wa, wb in zip(*(batch.column(c).to_pylist() for c in range(9))):
                a, b = np.frombuffer(wa, np.uint32), np.frombuffer(wb, np.uint32)
                for x0, x1, y0, y1, same in align(a, b, [x - xa for x in xs], ns, [y - ya for y in ys], identity):
                    if min(x1 - x0, y1 - y0) >= least:
                        out.append((row, crow, x0 + xa, x1 + xa, y0 + ya, y1 + ya, same))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    kept = None
    for part in range(PARTS):
        mine = windows.where(F.col("part") == part)
        one = mine.where("side = 0").select(F.col("r").alias("row"), F.col("lo").alias("xa"), F.col("hi").alias("xb"), F.col("words").alias("wa"))
        two = mine.where("side = 1").select(F.col("r").alias("crow"), F.col("lo").alias("ya"), F.col("hi").alias("yb"), F.col("words").alias("wb"))
        both = chains.where(F.col("part") == part).join(one, ["row", "xa", "xb"]).join(two, ["crow", "ya", "yb"])
        aligned = settle(both.select("row", "crow", "xa", "ya", "xs", "ns", "ys", "wa", "wb").mapInArrow(
            run, "row long, crow long, start long, end long, source_start long, source_end long, identity double"
        ), "aligned")
        kept = aligned if kept is None else kept.union(aligned)
        del both, one, two, mine
        release(docs.sparkSession)
    forget(windows)
    own = ids.select(F.col("_row"), "doc_id")
    src = ids.select(F.col("_row").alias("_src"), F.col("doc_id").alias("source_id"))
    return kept.join(own, F.col("row") == F.col("_row")).join(src, F.col("crow") == F.col("_src")).select(
        "doc_id", "start", "end", "source_id", "source_start", "source_end", "identity", "_row"
    )


def op2_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages of at least 50 words that repeat across documents."""
    return passages(table(spark, sf_dir, "documents")).drop("_row")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (word numbers), white space in between kept as it is."""
    places, at = [], 0
    import re

    for m in re.finditer(rb"[^\x20\x09-\x0d]+", text):
        places.append(m.span())
    out = bytearray()
    for start, end in sorted(spans):
        start, end = max(start, at), min(end, len(places))
        if start < end:
            a = places[at][0] if at else 0
            out += text[a:places[start][0]]
            at = end
    if at < len(places):
        out += text[places[at][0] if at else 0:]
    return bytes(out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without the passages that an earlier one has; n_chars follows the text.

    A document that is left without words goes.
    """
    bounded_batches(spark)
    spans = settle(
        passages(docs).groupBy(F.col("_row").alias("_of")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans")), "spans"
    )
    rows = numbered(docs).join(spans.hint("shuffle_hash"), F.col("_row") == F.col("_of"), "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: cut_words(t.encode("utf-8"), [(x["start"], x["end"]) for x in s]).decode("utf-8"))

    shorter = cut(F.col("doc.text"), F.col("_spans"))
    cut_rows = rows.where("_spans is not null").withColumn("_text", shorter).where(F.rlike(F.col("_text"), F.lit(r"[^\x20\x09-\x0D]")))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    return rows.where("_spans is null").select(*kept).union(cut_rows.select(*[new.get(c, k).alias(c) for c, k in zip(docs.columns, kept)]))
