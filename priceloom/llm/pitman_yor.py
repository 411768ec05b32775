"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling on the cluster.

Every context word is a restaurant whose customers are the words that follow it;
their tables are the customers of one parent restaurant, whose base is uniform. Seating is sampled
by Gibbs moves: every customer leaves and sits down again, at a table in proportion to
its size less the discount, or at a new one in proportion to the parent's probability.
Predictive probabilities are averaged over the last sweeps, restaurant by restaurant.

All of it moves as packed arrays. Texts become chunks of tokens; a chunk asks
the bucket of a context about its distinct word pairs, and the bucket of a word about its distinct words, and
gets arrays back in the order it asked. A sweep is an exchange between context buckets, which seat,
and word buckets, which add up the parent's customers. Frequent contexts are spread over
buckets by the following word, so no bucket grows with one word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import fresh_path, settle
from priceloom.llm.common import bounded_batches, crc_slot, forget, parallelism, release, table, text_of
from priceloom.llm.tokens import C1, mix, word_hashes

HELD_OUT_OF = 7
HELD_OUT = 2
# Tokens of a chunk, and of a bucket.
CHUNK_TOKENS = 1_200_000
BUCKET_TOKENS = 1_500_000
# Context buckets gather their pairs, and chunks are scored, in so many parts, one after another.
PARTS = 2
STRENGTH = 1.0
SWEEPS = 3
AVERAGED = 2
#: Gibbs moves of every customer in a sweep.
MOVES = 1
# Sizes of the tables of few customers, and in how many ways they are seated so.
SEATINGS = {
    1: [(1, (1,))],
    2: [(1, (2,)), (1, (1, 1))],
    3: [(1, (3,)), (3, (2, 1)), (1, (1, 1, 1))],
    4: [(1, (4,)), (4, (3, 1)), (3, (2, 2)), (6, (2, 1, 1)), (1, (1, 1, 1, 1))],
}
# Dishes of which fewer than this have customers left to move are reseated one by one.
FEW_DISHES = 48
_SHIFT = np.uint64(16)
# The end of a text, and the context of its first word; no word hashes white space.
_END_TEXT = b"\n"


def _squeeze(a: np.ndarray, delta: bool = False) -> bytes:
    """Integers or floats as compressed byte planes; sorted integers as differences."""
    import zstandard

    if delta and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _widen(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    a = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if delta else a


def _word_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids % np.uint64(buckets)).astype(np.int64)


def _pair_bucket(u: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the context; of the pair if the context is one of the sorted ``hot`` ones."""
    out = (mix(u) % np.uint64(buckets)).astype(np.int64)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, u), len(hot) - 1)] == u
        out[is_hot] = (mix(u[is_hot] * C1 + w[is_hot]) % np.uint64(buckets)).astype(np.int64)
    return out


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket and the ends of each."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def chunks(docs: DataFrame) -> DataFrame:
    """Texts as chunks of tokens: chunk, docs (doc_id, train, n), vocab (sorted hashes), tokens (places in vocab)."""
    import xxhash

    end = np.uint64(xxhash.xxh64_intdigest(_END_TEXT))
    docs_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("train", pa.bool_()), ("n", pa.int64())]))
    schema = pa.schema([("chunk", pa.int64()), ("docs", docs_type), ("vocab", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, about, size = [], [], 0

        def out():
            vocab, tokens = np.unique(np.concatenate(held), return_inverse=True)
            row = ([about[0][0]], [[{"doc_id": d, "train": t, "n": n} for _, d, t, n in about]],
                   [_squeeze(vocab, True)], [_squeeze(tokens.ravel().astype(np.int32))])
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(row, schema)], schema=schema)

        for batch in batches:
            words, counts = word_hashes(batch.column(3).cast(pa.binary()).to_pylist())
            at = np.cumsum(counts)
            tokens = np.insert(words, at, end)
            start = 0
            for i, n in enumerate((counts + 1).tolist()):
                held.append(tokens[start:start + n])
                about.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), n))
                start, size = start + n, size + n
                if size >= CHUNK_TOKENS:
                    yield out()
                    held, about, size = [], [], 0
        if held:
            yield out()

    rows = docs.select("_row", F.col("doc_id").cast("long"), (crc_slot("doc_id", HELD_OUT_OF) != HELD_OUT).alias("train"), text_of().alias("text"))
    return rows.mapInArrow(run, "chunk long, docs array<struct<doc_id:long,train:boolean,n:long>>, vocab binary, tokens binary")


@dataclass
class _Chunk:
    chunk: int
    doc_ids: list
    train: np.ndarray
    counts: np.ndarray
    vocab: np.ndarray
    tokens: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, i: int) -> "_Chunk":
        docs = batch.column(1)[i].as_py()
        return _Chunk(
            batch.column(0)[i].as_py(), [d["doc_id"] for d in docs], np.array([d["train"] for d in docs], bool),
            np.array([d["n"] for d in docs], np.int64), _widen(batch.column(2)[i].as_py(), np.uint64, True),
            _widen(batch.column(3)[i].as_py(), np.int32),
        )

    def contexts(self) -> np.ndarray:
        """The token before each, at the start of a text its end token."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[0] = self.tokens[-1]  # an end too: every text ends with one
        return before

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) codes in order, their place per token, and how often each occurs in training texts."""
        code = self.contexts().astype(np.int64) * len(self.vocab) + self.tokens
        kinds, place = np.unique(code, return_inverse=True)
        place = place.ravel()
        return kinds, place, np.bincount(place[np.repeat(self.train, self.counts)], minlength=len(kinds))


def _ask_words(parts: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and word bucket: its words."""
    schema = pa.schema([("wb", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                vocab = _widen(packed.as_py(), np.uint64, True)
                order, ends = _by_bucket(_word_bucket(vocab >> _SHIFT, buckets), buckets)
                rows = [(b, chunk, _squeeze(vocab[order[s:e]], True)) for b, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if e > s]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return parts.select("chunk", "vocab").mapInArrow(run, "wb long, chunk long, words binary")


def _told_words(parts: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and word bucket: its words and how often they occur in training texts."""
    schema = pa.schema([("wb", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk.of(batch, i)
                n = np.bincount(c.tokens[np.repeat(c.train, c.counts)], minlength=len(c.vocab)).astype(np.int64)
                order, ends = _by_bucket(_word_bucket(c.vocab >> _SHIFT, buckets), buckets)
                rows = [(b, c.chunk, _squeeze(c.vocab[order[s:e]], True), _squeeze(n[order[s:e]])) for b, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if e > s]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return parts.mapInArrow(run, "wb long, chunk long, words binary, n binary")


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    words = np.concatenate([_widen(x, np.uint64, True) for x in pdf["words"]])
    n = np.concatenate([_widen(x, np.int64) for x in pdf["n"]])
    kinds, place = np.unique(words, return_inverse=True)
    count = np.bincount(place.ravel(), weights=n, minlength=len(kinds)).astype(np.int64)
    return pd.DataFrame({"wb": [pdf["wb"].iloc[0]], "words": [_squeeze(kinds, True)], "n": [_squeeze(count)],
                         "tokens": [int(count.sum())], "types": [int((count > 0).sum())]})


def _ask_pairs(parts: DataFrame, hot: np.ndarray, buckets: int, part: int) -> DataFrame:
    """Per chunk and context bucket of the ``part``: its word pairs and how often they occur in training texts."""
    schema = pa.schema([("ub", pa.int64()), ("chunk", pa.int64()), ("u", pa.binary()), ("w", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk.of(batch, i)
                kinds, _, n = c.pairs()
                ids = c.vocab >> _SHIFT
                u, w = ids[kinds // len(ids)], ids[kinds % len(ids)]
                order, ends = _by_bucket(_pair_bucket(u, w, hot, buckets), buckets)
                for b, (s, e) in enumerate(zip(ends[:-1], ends[1:])):
                    if e > s and b % PARTS == part:
                        o = order[s:e]
                        row = (b, c.chunk, _squeeze(u[o], True), _squeeze(w[o]), _squeeze(n[o].astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema)], schema=schema)

    return parts.mapInArrow(run, "ub long, chunk long, u binary, w binary, n binary")


_PACKETS = "kind string, a long, b long, p1 binary, p2 binary, p3 binary, p4 binary, p5 binary, p6 binary, x double, y double"
_PACKET_SCHEMA = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())] + [(f"p{i}", pa.binary()) for i in range(1, 7)] + [("x", pa.float64()), ("y", pa.float64())])


def _packet(kind: str, a: int, b: int, *parts: bytes, x: float = 0.0, y: float = 0.0) -> dict:
    return {"kind": kind, "a": a, "b": b, **{f"p{i}": parts[i - 1] if i <= len(parts) else None for i in range(1, 7)}, "x": x, "y": y}


def _word_packets(kind: str, bucket: int, ids: np.ndarray, counts: np.ndarray, buckets: int, more: np.ndarray | None = None) -> list[dict]:
    """``counts`` of the distinct ``ids``, to each word bucket."""
    order, ends = _by_bucket(_word_bucket(ids, buckets), buckets)
    return [
        _packet(kind, b, bucket, _squeeze(ids[order[s:e]], True), _squeeze(counts[order[s:e]]), *([_squeeze(more[order[s:e]])] if more is not None else []))
        for b, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if e > s
    ]


def _sum_by(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, place = np.unique(ids, return_inverse=True)
    return kinds, np.bincount(place.ravel(), weights=values, minlength=len(kinds))


def _gather_pairs(buckets: int):
    """A context bucket from all requests: pairs that occur twice or more, restaurants, and what each chunk asked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        bucket = int(pdf["ub"].iloc[0])
        us = [_widen(x, np.uint64, True) for x in pdf["u"]]
        sizes = [len(x) for x in us]
        u, w = np.concatenate(us), np.concatenate([_widen(x, np.uint64) for x in pdf["w"]])
        n = np.concatenate([_widen(x, np.int32) for x in pdf["n"]])
        del us
        _, first, place = np.unique(mix(u * C1 + w), return_index=True, return_inverse=True)
        place = place.ravel()
        c = np.bincount(place, weights=n, minlength=len(first)).astype(np.int64)
        pu, pw = u[first], w[first]
        del u, w, n
        often = np.nonzero(c >= 2)[0]
        often = often[np.lexsort((pw[often], pu[often]))]
        what = np.where(c == 1, 1, 0).astype(np.int32)
        what[often] = np.arange(2, len(often) + 2)
        out, at = [], 0
        for chunk, size in zip(pdf["chunk"], sizes):
            out.append(_packet("index", int(chunk), bucket, _squeeze(what[place[at:at + size]])))
            at += size
        seen = c > 0
        ru, rc = _sum_by(pu[seen], c[seen])
        su, sc = _sum_by(pu[c == 1], np.ones(int((c == 1).sum())))
        singles = np.zeros(len(ru))
        singles[np.searchsorted(ru, su)] = sc
        out.append(_packet(
            "state", bucket, 0, _squeeze(pu[often], True), _squeeze(pw[often]), _squeeze(c[often]), _squeeze(ru, True),
            _squeeze(rc.astype(np.int64)), _squeeze(singles.astype(np.int64)), x=float((c == 1).sum()), y=float((c == 2).sum()),
        ))
        out += _word_packets("single", bucket, *_sum_by(pw[c == 1], np.ones(int((c == 1).sum()))), buckets)
        out += _word_packets("tables", bucket, *_sum_by(pw[often], np.ones(len(often))), buckets)
        return pd.DataFrame(out)

    return run


def reseat(sizes: np.ndarray, begins: np.ndarray, counts: np.ndarray, weight: np.ndarray, discount: float, moves: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """``moves`` Gibbs moves of every customer of many dishes at once.

    ``sizes`` are the tables of all dishes one after another, ``begins`` where those of a dish start,
    ``counts`` its customers, ``weight`` what a new table weighs. Customers leave one after the other, in a random
    order, and sit down again; empty tables go. All customers of a dish of up to four are seated at once, by the
    chances of all their seatings, where such moves lead. Returns the new sizes and begins.
    """
    if not moves:
        return sizes, begins
    n_tables = np.diff(np.append(begins, len(sizes)))
    # the dishes that can change, those of many customers first: they take part in more rounds
    busy = np.nonzero(counts > max(SEATINGS))[0]
    busy = busy[np.argsort(-counts[busy], kind="stable")]
    c, w, t = counts[busy].astype(np.int64), weight[busy], n_tables[busy]
    start = np.cumsum(c) - c
    # a dish has as many places for tables as customers
    place = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
    taken, at = np.repeat(start, t) + place, np.repeat(begins[busy], t) + place
    kind = np.int32 if c.sum() < 2**31 else np.int64
    people = np.zeros(c.sum(), kind)
    people[taken] = sizes[at]
    seat = np.repeat(taken, sizes[at]).astype(kind)
    free = np.arange(len(seat), dtype=kind) + np.repeat(t, c).astype(kind)
    top = start + c - t
    for _ in range(moves):
        left, k = len(busy), 0
        while left:
            left = int(np.searchsorted(-c[:left], -k, side="left"))
            if left < FEW_DISHES:
                for i in range(left):
                    top[i] = _reseat_one(seat, people, free, int(start[i]), int(c[i]), int(top[i]), float(w[i]), discount, k, rng)
                break
            who = start[:left] + k
            drawn = who + (rng.random(left) * (c[:left] - k)).astype(np.int64)
            table = seat[drawn]
            seat[drawn] = seat[who]
            people[table] -= 1
            gone = np.nonzero(people[table] == 0)[0]
            free[top[gone]] = table[gone]
            top[gone] += 1
            # beside another customer, and with a chance of discount / size not after all
            waiting, others = np.arange(left), c[:left] - 1
            while len(waiting):
                drawn = rng.random(len(waiting)) * (others[waiting] + w[waiting])
                step = drawn.astype(np.int64)
                opens = step >= others[waiting]
                # the k-th place, that of the customer who stands, is none of the others
                beside = seat[start[waiting] + np.where(opens, k, k + 1 + step) % c[waiting]]
                stays = opens | ((drawn - step) * people[beside] < people[beside] - discount)
                new, old = waiting[stays & opens], waiting[stays & ~opens]
                table[old] = beside[stays & ~opens]
                top[new] -= 1
                table[new] = free[top[new]]
                waiting = waiting[~stays]
            people[table] += 1
            seat[who] = table
            k += 1
    live = np.nonzero(people)[0]
    dish, out = [np.repeat(busy, c)[live]], [people[live]]
    for count, ways in SEATINGS.items():
        few = np.nonzero(counts == count)[0]
        chance = [
            n * np.prod([j - discount for size in way for j in range(1, size)]) * weight[few] ** (len(way) - 1) for n, way in ways
        ]
        upto = np.cumsum(chance, axis=0)
        way_of = (rng.random(len(few)) * upto[-1] >= upto[:-1]).sum(axis=0)
        for i, (_, way) in enumerate(ways):
            mine = few[way_of == i]
            dish.append(np.repeat(mine, len(way)))
            out.append(np.tile(np.array(way), len(mine)))
    dish = np.concatenate(dish)
    order = np.argsort(dish, kind="stable")
    return np.concatenate(out).astype(sizes.dtype)[order], np.searchsorted(dish[order], np.arange(len(begins)))


def _reseat_one(seat: np.ndarray, people: np.ndarray, free: np.ndarray, start: int, count: int, top: int, weight: float, discount: float, k: int, rng) -> int:
    """The moves of the customers of one dish from the ``k``-th on, as ``reseat`` makes them; its free places then end at the number returned."""
    seat, people, free = memoryview(seat), memoryview(people), memoryview(free)
    others, drawn, order = count - 1, iter(()), iter(())
    for k in range(k, count):
        x = next(order, None)
        if x is None:
            order = iter(rng.random(min(1 << 16, count - k)).tolist())
            x = next(order)
        who = start + k + int(x * (count - k))
        table = seat[who]
        seat[who] = seat[start + k]
        people[table] -= 1
        if not people[table]:
            free[top] = table
            top += 1
        while True:
            x = next(drawn, None)
            if x is None:
                drawn = iter((rng.random(min(1 << 16, 2 * (count - k) + 8)) * (others + weight)).tolist())
                x = next(drawn)
            step = int(x)
            if step >= others:
                top -= 1
                table = free[top]
                break
            table = seat[start + (k + 1 + step) % count]
            if (x - step) * people[table] < people[table] - discount:
                break
        people[table] += 1
        seat[start + k] = table
    return top


def first_seats(counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A start for the sampler: about as many tables as a restaurant with these weights expects, of even size."""
    tables = np.clip(np.rint(weight * np.log1p(counts / np.maximum(weight, 1e-12))), 1, counts).astype(np.int64)
    begins = np.cumsum(tables) - tables
    place = np.arange(tables.sum()) - np.repeat(begins, tables)
    return np.repeat(counts // tables, tables) + (place < np.repeat(counts % tables, tables)), begins


@dataclass
class _Parent:
    """What the parent restaurant shares with all buckets: numbers only."""

    discount: float
    parent_discount: float
    types: int
    customers: float
    tables: float

    def floor(self) -> float:
        return (STRENGTH + self.parent_discount * self.tables) / (STRENGTH + self.customers) / (self.types + 1)

    def probability(self, rest: np.ndarray) -> np.ndarray:
        """From the customers of a word less the discount of its tables."""
        return rest / (STRENGTH + self.customers) + self.floor()


def _add_parent(parent: _Parent, sweep: int, buckets: int):
    """A word bucket in one sweep: the parent's customers and tables of its words, and the answer to each context bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["a"].iloc[0])
        rng = np.random.default_rng([sweep, bucket])
        asked = [(int(r.b), _widen(r.p1, np.uint64, True), _widen(r.p2, np.float64)) for r in pdf[pdf["kind"].isin(["single", "tables"])].itertuples()]
        kinds = pdf["kind"][pdf["kind"].isin(["single", "tables"])].tolist()
        if not asked:
            return pd.DataFrame([], columns=[f.name for f in _PACKET_SCHEMA])
        ids, customers = _sum_by(np.concatenate([x[1] for x in asked]), np.concatenate([x[2] for x in asked]))
        customers = customers.astype(np.int64)
        weight = np.full(len(ids), (STRENGTH + parent.parent_discount * parent.tables) / (parent.types + 1))
        sizes, begins = first_seats(customers, weight)
        sizes, begins = reseat(sizes, begins, customers, weight, parent.parent_discount, MOVES, rng)
        tables = np.diff(np.append(begins, len(sizes)))
        rest = customers - parent.parent_discount * tables
        out = [_packet("word", bucket, sweep, _squeeze(ids, True), _squeeze(rest), x=float(customers.sum()), y=float(tables.sum()))]
        for kind, (ub, words, _) in zip(kinds, asked):
            if kind == "tables":
                out.append(_packet("answer", ub, bucket, _squeeze(rest[np.searchsorted(ids, words)])))
        return pd.DataFrame(out)

    return run


def _seat(parent: _Parent, hot: dict[int, tuple[int, float]], sweep: int, averaged: bool, buckets: int):
    """A context bucket in one sweep: seats its pairs with the parent's answers and tells the word buckets their tables.

    A bucket has pairs u, w, c, restaurants, customers and singles in ``p1``..``p6``; its seating goes out
    as ``seats``, ``starts`` and ``sums`` (tables over the kept sweeps).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket = row["a"]
                rng = np.random.default_rng([1_000 + sweep, bucket])
                u, w, c = _widen(row["p1"], np.uint64, True), _widen(row["p2"], np.uint64), _widen(row["p3"], np.int64)
                ru, singles = _widen(row["p4"], np.uint64, True), _widen(row["p6"], np.int64)
                out, t, sums, begins, sizes = [], np.zeros(0, np.int64), np.zeros(len(u), np.float32), None, None
                if len(u):
                    kinds = np.unique(w)
                    order, ends = _by_bucket(_word_bucket(kinds, buckets), buckets)
                    rest = np.zeros(len(kinds))
                    for answer in row["answers"]:
                        rest[order[ends[answer["b"]]:ends[answer["b"] + 1]]] = _widen(answer["p1"], np.float64)
                    p = parent.probability(rest)[np.searchsorted(kinds, w)]
                    at = np.searchsorted(ru, u)
                    if row["seats"] is None:
                        tables = np.ones(len(u))
                    else:
                        sizes, begins = _widen(row["seats"], np.int32).astype(np.int64), _widen(row["starts"], np.int64, True)
                        tables = np.diff(np.append(begins, len(sizes)))
                        sums = _widen(row["sums"], np.float32)
                    open_tables = singles + np.bincount(at, weights=tables, minlength=len(ru))
                    for i, place in _hot_places(ru, hot):
                        open_tables[place] = hot[i][1]
                    weight = (STRENGTH + parent.discount * open_tables[at]) * p
                    if sizes is None:
                        sizes, begins = first_seats(c, weight)
                    sizes, begins = reseat(sizes, begins, c, weight, parent.discount, MOVES, rng)
                    t = np.diff(np.append(begins, len(sizes)))
                    if averaged:
                        sums = sums + t.astype(np.float32)
                    out += _word_packets("tables", bucket, *_sum_by(w, t), buckets)
                state = _packet("seats", bucket, 0)
                state |= {"seats": _squeeze(sizes.astype(np.int32)) if len(u) else None, "starts": _squeeze(begins, True) if len(u) else None,
                          "sums": _squeeze(sums)}
                tables = singles + (np.bincount(np.searchsorted(ru, u), weights=t, minlength=len(ru)) if len(u) else 0)
                state["hot"] = [{"id": int(ru[place]), "tables": float(tables[place])} for _, place in _hot_places(ru, hot)]
                yield pa.RecordBatch.from_pylist([state] + [o | {"seats": None, "starts": None, "sums": None, "hot": []} for o in out], schema=_STATE_SCHEMA)

    return run


def _hot_places(ru: np.ndarray, hot: dict) -> list[tuple[int, int]]:
    """The frequent contexts among the sorted restaurants, with their places."""
    ids = np.array(sorted(hot), dtype=np.uint64)
    if not len(ids) or not len(ru):
        return []
    at = np.minimum(np.searchsorted(ru, ids), len(ru) - 1)
    return [(int(i), int(p)) for i, p in zip(ids, at) if ru[p] == i]


_STATE = _PACKETS + ", seats binary, starts binary, sums binary, hot array<struct<id:long,tables:double>>"
_STATE_SCHEMA = pa.schema([*_PACKET_SCHEMA, ("seats", pa.binary()), ("starts", pa.binary()), ("sums", pa.binary()),
                           ("hot", pa.list_(pa.struct([("id", pa.int64()), ("tables", pa.float64())])))])


def _answer_pairs(discount: float, kept: int):
    """Values of the pairs that every chunk asked: customers less the mean discount of their tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, sums = _widen(row["p3"], np.int64), _widen(row["sums"], np.float32)
                values = np.concatenate([[0.0, 1 - discount], c - discount * sums / kept]).astype(np.float32)
                out = [{"chunk": i["a"], "ub": row["a"], "values": _squeeze(values[_widen(i["p1"], np.int32)])} for i in row["asked"]]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("ub", pa.int64()), ("values", pa.binary())]))

    return run


def _restaurants(kept: int, buckets: int):
    """Mean tables and customers of every restaurant, to the bucket of its word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                u, ru = _widen(row["p1"], np.uint64, True), _widen(row["p4"], np.uint64, True)
                tables = _widen(row["p6"], np.int64).astype(np.float64)
                if len(u):
                    tables = tables + np.bincount(np.searchsorted(ru, u), weights=_widen(row["sums"], np.float32) / kept, minlength=len(ru))
                rows = _word_packets("restaurant", row["a"], ru, tables, buckets, _widen(row["p5"], np.int64))
                yield pa.RecordBatch.from_pylist(rows, schema=_PACKET_SCHEMA)

    return run


def _answer_words(parents: list[_Parent], discount: float):
    """A word bucket at the end: answers every chunk with count, mean parent probability, and the restaurant's weights."""
    floor = float(np.mean([p.floor() for p in parents]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for r in pdf[pdf["kind"] == "counts"].itertuples():
            words, counts = _widen(r.p1, np.uint64, True), _widen(r.p2, np.int64)
        ids = np.unique(words >> _SHIFT)
        p = np.full(len(ids), floor)
        for r in pdf[pdf["kind"] == "word"].itertuples():
            one = parents[int(r.x)]
            p[np.searchsorted(ids, _widen(r.p1, np.uint64, True))] += _widen(r.p2, np.float64) / (STRENGTH + one.customers) / len(parents)
        tables, customers = np.zeros(len(ids)), np.zeros(len(ids))
        for r in pdf[pdf["kind"] == "restaurant"].itertuples():
            at = np.searchsorted(ids, _widen(r.p1, np.uint64, True))
            tables[at] += _widen(r.p2, np.float64)
            customers[at] += _widen(r.p3, np.int64)
        out = []
        for r in pdf[pdf["kind"] == "asked"].itertuples():
            asked = _widen(r.p1, np.uint64, True)
            at = np.searchsorted(ids, asked >> _SHIFT)
            out.append({
                "chunk": int(r.b), "wb": int(r.a), "n": _squeeze(counts[np.searchsorted(words, asked)]), "p": _squeeze(p[at]),
                "open": _squeeze((STRENGTH + discount * tables[at]).astype(np.float32)), "all": _squeeze((STRENGTH + customers[at]).astype(np.float32)),
            })
        return pd.DataFrame(out, columns=["chunk", "wb", "n", "p", "open", "all"])

    return run


def _score(hot: np.ndarray, buckets: int, total: int, types: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk.of(batch, i)
                ids = c.vocab >> _SHIFT
                n, p, open_, all_ = (np.zeros(len(ids), t) for t in (np.int64, np.float64, np.float32, np.float32))
                order, ends = _by_bucket(_word_bucket(ids, buckets), buckets)
                for a in batch.column(4)[i].as_py():
                    at = order[ends[a["wb"]]:ends[a["wb"] + 1]]
                    n[at], p[at] = _widen(a["n"], np.int64), _widen(a["p"], np.float64)
                    open_[at], all_[at] = _widen(a["open"], np.float32), _widen(a["all"], np.float32)
                kinds, place, _ = c.pairs()
                u, w = kinds // len(ids), kinds % len(ids)
                order, ends = _by_bucket(_pair_bucket(ids[u], ids[w], hot, buckets), buckets)
                value = np.zeros(len(kinds))
                for a in batch.column(5)[i].as_py():
                    value[order[ends[a["ub"]]:ends[a["ub"] + 1]]] = _widen(a["values"], np.float32)
                logs = np.log10((value + open_[u].astype(np.float64) * p[w]) / all_[u])
                begins = np.cumsum(c.counts) - c.counts
                base = np.log10((n + 1) / (total + types + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(c.doc_ids, type=pa.int64()), pa.array(~c.train), pa.array(c.counts),
                    pa.array(np.add.reduceat((n > 0)[c.tokens].astype(np.int64), begins)),
                    pa.array(np.add.reduceat(base[c.tokens], begins)), pa.array(np.add.reduceat(logs[place], begins)),
                ], schema=schema)

    return run


class _Packets:
    """Packets written apart by kind."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.schema, self.path = df.sparkSession, df.schema, fresh_path(df.sparkSession, label)
        self.add(df)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").partitionBy("kind").parquet(self.path)

    def __call__(self, kind: str) -> DataFrame:
        read = self.spark.read.schema(self.schema).parquet(self.path)
        return read.where(F.col("kind") == kind).select(*self.schema.fieldNames())

    def forget(self, kind: str | None = None) -> None:
        """Remove the table, or the packets of one kind, once nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + (f"/kind={kind}" if kind else ""))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _merge_singles():
    """A word bucket's tables of pairs that occur once, which never change, as one packet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n = _sum_by(np.concatenate([_widen(x, np.uint64, True) for x in pdf["p1"]]), np.concatenate([_widen(x, np.float64) for x in pdf["p2"]]))
        return pd.DataFrame([_packet("single", int(pdf["a"].iloc[0]), -1, _squeeze(ids, True), _squeeze(n))])

    return run


def score_texts(docs: DataFrame, sweeps: int = SWEEPS, kept: int = AVERAGED) -> DataFrame:
    """Score of every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``docs`` has doc_id and text. Texts whose crc32(doc_id) mod 7 is 2 are held out of training. A null text is
    empty, its only token the end; repeated rows are texts of their own; without training texts every word has the
    uniform probability of one unknown word; other columns are not read. Words are told apart by a
    64-bit hash, word pairs by 48 bits of each. Discounts are set from the numbers of pairs that
    occur once and twice.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = settle(chunks(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())), "lm-chunks")
    tokens = parts.select(F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["n"]))).first()[0] or 0
    buckets = max(parallelism(spark), -(-tokens // BUCKET_TOKENS))
    counted = settle(_told_words(parts, buckets).groupBy("wb").applyInPandas(_count_words, "wb long, words binary, n binary, tokens long, types long"), "lm-counts")
    release(spark)
    total, types = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    hot_counts = _frequent(counted, total / (4 * buckets))
    hot_ids = np.array(sorted(hot_counts), dtype=np.uint64)
    # in parts, so that the pairs of one part alone are shuffled at a time
    gathered = None
    for part in range(PARTS):
        pairs = _ask_pairs(parts, hot_ids, buckets, part).groupBy("ub").applyInPandas(_gather_pairs(buckets), _PACKETS)
        if gathered is None:
            gathered = _Packets(pairs, "lm-pairs")
        else:
            gathered.add(pairs)
        del pairs
        release(spark)
    once, twice = gathered("state").agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    discount = min(max((once + 0.5) / (once + 2 * twice + 1), 0.1), 0.95)
    parent = _Parent(discount, 0.5, types, float(max(types, 1)), float(max(types, 1)))
    columns = [f.name for f in _PACKET_SCHEMA]
    static, seats = gathered("state"), None
    singles = settle(gathered("single").groupBy("a").applyInPandas(_merge_singles(), _PACKETS), "lm-singles")
    gathered.forget("single")
    hot = {i: (c, 0.0) for i, c in hot_counts.items()}
    hot = _hot_tables(static, hot)
    words, parents, tolds = [], [], []
    for sweep in range(sweeps):
        averaged = sweep >= sweeps - kept
        tables = (gathered if seats is None else seats)("tables").select(*columns)
        told = _Packets(singles.union(tables).groupBy("a").applyInPandas(_add_parent(parent, sweep, buckets), _PACKETS), "lm-parent")
        customers, seated = told("word").agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        parent = _Parent(discount, parent.parent_discount, types, customers, seated)
        if averaged:
            words.append(told("word").withColumn("x", F.lit(float(len(parents)))))
            parents.append(parent)
            tolds.append(told)
        answers = told("answer").groupBy(F.col("a").alias("_a")).agg(F.collect_list(F.struct("b", "p1")).alias("answers"))
        ready = _with_seats(static, seats).join(answers, F.col("a") == F.col("_a"), "left").select(
            *columns, "seats", "starts", "sums", F.coalesce("answers", F.array()).alias("answers")
        )
        # the tables told of the sweep before are in ``told``
        (gathered if seats is None else seats).forget("tables")
        former, seats = seats, _Packets(ready.mapInArrow(_seat(parent, hot, sweep, averaged, buckets), _STATE), "lm-seats")
        if former is not None:
            former.forget()
        told.forget("answer" if averaged else None)
        del ready, answers, tables
        release(spark)
        hot = {
            i: (hot[i][0], t) for i, t in (
                (r["id"], r["t"]) for r in seats("seats").select(F.explode("hot").alias("h")).groupBy(F.col("h.id").alias("id")).agg(F.sum("h.tables").alias("t")).collect()
            )
        }
        hot = {i: hot.get(i, (c, 0.0)) for i, c in hot_counts.items()}
    state = _with_seats(static, seats)
    index = gathered("index").groupBy(F.col("b").alias("_b")).agg(F.collect_list(F.struct("a", "p1")).alias("asked"))
    # the answers are written one kind after the other, so that their shuffles do not stand side by side
    values = settle(state.join(index, F.col("a") == F.col("_b")).select("a", "p3", "sums", "asked").mapInArrow(
        _answer_pairs(discount, kept), "chunk long, ub long, values binary"
    ), "lm-pair-values")
    del index
    gathered.forget("index")
    release(spark)
    restaurants = settle(state.mapInArrow(_restaurants(kept, buckets), _PACKETS).select(*columns), "lm-restaurants")
    for table_ in (gathered, seats):
        table_.forget()
    forget(singles)
    del state, static
    release(spark)
    blank = {c: F.lit(None).cast("binary") for c in ("p3", "p4", "p5", "p6")} | {"x": F.lit(0.0), "y": F.lit(0.0)}
    of_counts = counted.select(F.lit("counts").alias("kind"), F.col("wb").alias("a"), F.lit(0).cast("long").alias("b"), F.col("words").alias("p1"), F.col("n").alias("p2")).withColumns(blank)
    known = restaurants.union(of_counts.select(*columns))
    for w in words:
        known = known.union(w.select(*columns))
    scored = None
    # chunks ask about their words and meet their answers in parts, one after another, so that the answers of one part alone
    # are written, and the chunks of one part alone are shuffled, at a time
    for part in range(PARTS):
        mine = [x.where(F.pmod(F.xxhash64("chunk"), F.lit(PARTS)) == part) for x in (parts, values)]
        of_asked = _ask_words(mine[0], buckets).select(F.lit("asked").alias("kind"), F.col("wb").alias("a"), F.col("chunk").alias("b"), F.col("words").alias("p1"), F.lit(None).cast("binary").alias("p2")).withColumns(blank)
        word_values = settle(known.union(of_asked.select(*columns)).groupBy("a").applyInPandas(
            _answer_words(parents, discount), "chunk long, wb long, n binary, p binary, open binary, all binary"
        ), "lm-word-values")
        del of_asked
        release(spark)
        of_words = word_values.groupBy(F.col("chunk").alias("_c2")).agg(F.collect_list(F.struct("wb", "n", "p", "open", "all")).alias("word_values"))
        of_pairs = mine[1].groupBy(F.col("chunk").alias("_c1")).agg(F.collect_list(F.struct("ub", "values")).alias("pair_values"))
        full = mine[0].join(of_words, F.col("chunk") == F.col("_c2")).join(of_pairs, F.col("chunk") == F.col("_c1"))
        one = settle(full.select("chunk", "docs", "vocab", "tokens", "word_values", "pair_values").mapInArrow(
            _score(hot_ids, buckets, total, types), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        ), "lm-scores")
        scored = one if scored is None else scored.union(one)
        forget(word_values)
        del mine, of_words, of_pairs, full, word_values
        release(spark)
    for table_ in tolds:
        table_.forget()
    for table_ in (parts, counted, restaurants, values):
        forget(table_)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def _with_seats(static: DataFrame, seats: _Packets | None) -> DataFrame:
    """Context buckets with their seating so far, null before the first sweep."""
    if seats is None:
        return static.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("seats", "starts", "sums")])
    return static.join(seats("seats").select(F.col("a").alias("_s"), "seats", "starts", "sums"), F.col("a") == F.col("_s")).drop("_s")


def _frequent(counted: DataFrame, least: float) -> dict[int, int]:
    """Words with more than ``least`` training tokens, fewer than tokens / least; by their 48 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, n = _sum_by(_widen(row["words"], np.uint64, True) >> _SHIFT, _widen(row["n"], np.int64))
                some = n > least
                yield pa.RecordBatch.from_arrays([pa.array(ids[some].astype(np.int64)), pa.array(n[some].astype(np.int64))], names=["id", "n"])

    return {r["id"]: r["n"] for r in counted.select("words", "n").mapInArrow(run, "id long, n long").collect()}


def _hot_tables(state: DataFrame, hot: dict) -> dict:
    """Tables of the frequent contexts over all their buckets, before any sampling: one per kind of pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ru, u = _widen(row["p4"], np.uint64, True), _widen(row["p1"], np.uint64, True)
                tables = _widen(row["p6"], np.int64) + (np.bincount(np.searchsorted(ru, u), minlength=len(ru)) if len(u) else 0)
                places = _hot_places(ru, hot)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in places], pa.int64()), pa.array([float(tables[p]) for _, p in places], pa.float64())], names=["id", "t"])

    sums = state.select("p1", "p4", "p6").mapInArrow(run, "id long, t double").groupBy("id").agg(F.sum("t").alias("t")).collect()
    found = {r["id"]: r["t"] for r in sums}
    return {i: (c, found.get(i, 0.0)) for i, (c, _) in hot.items()}


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of the training documents."""
    return score_texts(table(spark, sf_dir, "documents"))
