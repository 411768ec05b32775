"""Convolutional text classifier on hashed word embeddings, trained in numpy on all labelled texts, shard by shard.

A word is the sum of two hashed embeddings, of the word and of its first letters.
Filters of several widths run over the words of the whole text, each keeps its largest response, and a
logistic layer reads those. Every shard of the labelled rows trains a copy of the model in a task; after each round the
copies are averaged, an embedding by how often each touched it. Scores are calibrated on all of the labelled rows that were not trained
on, and every language gets a threshold of its own from them; language is never an
input of the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm.common import bounded_batches, crc_slot, parallelism, release, table, text_of
from priceloom.llm.tokens import remembered

# About so many labelled rows train one copy of the model; there are as many shards as the rows need.
SHARD_ROWS = 8192
# Rounds over all rows if there are many shards; one shard takes EPOCHS of them.
ROUNDS = 2
# Cuts of the score that a language's threshold may take lie between bins of this width.
SCORE_BINS = 4096
# Rows of the embedding that are averaged together.
BLOCK = 4096
#: Score from which a text is predicted toxic; the threshold of languages with too few labels.
THRESHOLD = 0.3
#: A language needs this many labelled rows of both classes, among those kept for calibration, for its own threshold.
LANGUAGE_ROWS = 20
HELD_OUT_OF = 4
HELD_OUT = 2

BUCKETS = 1 << 16
PREFIX = 5
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 6
BATCH = 32
RATE = 0.01
MEMORY_WORDS = 400_000
# Words convolved at once.
CHUNK = 1 << 15
_TRIM = re.compile(rb"^[^\w\x80-\xff]+|[^\w\x80-\xff]+$")


class Words:
    """Hashed ids of words, remembered per worker: bucket of the word and of its first letters; bucket 0 is padding."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode("utf-8", "replace").split()
        if len(self.known) > MEMORY_WORDS:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = self._hash(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    @staticmethod
    def _hash(word: bytes) -> int:
        import xxhash

        w = _TRIM.sub(b"", word) or word
        start = w.decode("utf-8")[:PREFIX].encode("utf-8")
        return (1 + xxhash.xxh32_intdigest(w) % (BUCKETS - 1)) << 32 | (1 + xxhash.xxh32_intdigest(start, seed=1) % (BUCKETS - 1))


@dataclass
class Model:
    """Weights: embeddings, one kernel per width (width * dims x filters), output layer, calibration of the score."""

    embed: np.ndarray
    kernels: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    offset: float = 0.0

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return self.embed[ids >> 32] + self.embed[ids & 0xFFFFFFFF]

    def pooled(self, texts: list[np.ndarray], places: bool = False):
        """Largest response of every filter over each whole text, convolved in bounded chunks."""
        pad = np.zeros(max(WIDTHS) - 1, dtype=np.int64)
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
        spot = np.zeros(best.shape, dtype=np.int64) if places else None
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
                size += len(texts[end]) + len(pad)
                end += 1
            if end - at == 1:  # one text, of any length
                n = max(len(texts[at]), 1)
                ids = np.concatenate([texts[at], pad, pad[:1]]) if not len(texts[at]) else np.concatenate([texts[at], pad])
                for start in range(0, n, CHUNK):
                    y = self._convolve(ids[start:start + CHUNK + len(pad)])[: min(CHUNK, n - start)]
                    top = y.max(axis=0)
                    if places:
                        spot[at] = np.where(top > best[at], y.argmax(axis=0) + start, spot[at])
                    best[at] = np.maximum(best[at], top)
            else:
                parts = [t if len(t) else pad[:1] for t in texts[at:end]]
                ids = np.concatenate([a for t in parts for a in (t, pad)])
                lengths = np.array([len(t) for t in parts])
                starts = np.concatenate([[0], np.cumsum(lengths + len(pad))[:-1]])
                y = self._convolve(ids)
                # responses at the padding see no whole word of the next text, nor do they count
                cuts = np.stack([starts, starts + lengths], axis=1).ravel()
                y = np.concatenate([y, np.full((1, y.shape[1]), -np.inf, dtype=np.float32)])
                best[at:end] = np.maximum.reduceat(y, cuts, axis=0)[::2]
                if places:
                    for i, (s, n) in enumerate(zip(starts, lengths)):
                        spot[at + i] = y[s:s + n].argmax(axis=0)
            at = end
        return (best, spot) if places else best

    def _convolve(self, ids: np.ndarray) -> np.ndarray:
        x = self.rows(ids)
        y = x @ np.concatenate([k.reshape(w, DIMS, FILTERS).transpose(1, 0, 2).reshape(DIMS, -1) for w, k in zip(WIDTHS, self.kernels)], axis=1)
        out, column = [], 0
        for w, shift in zip(WIDTHS, self.shifts):
            part = y[:, column:column + FILTERS].copy()
            for o in range(1, w):
                part[:-o] += y[o:, column + o * FILTERS:column + (o + 1) * FILTERS]
            out.append(part + shift)
            column += w * FILTERS
        return np.concatenate(out, axis=1)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(texts), 0) @ self.out + self.bias

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.offset, -50, 50)))


def new_model(seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    embed[0] = 0
    kernels = [rng.normal(0, 1 / np.sqrt(w * DIMS), (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(embed, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                 rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)


class _Adam:
    def __init__(self, size: tuple, rate: float):
        self.m, self.v, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), rate

    def step(self, weight: np.ndarray, grad: np.ndarray, t: int, rows=None):
        """Dense, or only the rows that the batch touched."""
        at = slice(None) if rows is None else rows
        self.m[at] = 0.9 * self.m[at] + 0.1 * grad
        self.v[at] = 0.999 * self.v[at] + 0.001 * grad * grad
        weight[at] -= self.rate * (self.m[at] / (1 - 0.9**t)) / (np.sqrt(self.v[at] / (1 - 0.999**t)) + 1e-7)


class _Trainer:
    """A copy of the model, fitted by Adam on the log loss. Only the winning windows of a text pass gradients."""

    def __init__(self, model: Model):
        self.model = Model(model.embed.copy(), [k.copy() for k in model.kernels], [x.copy() for x in model.shifts], model.out.copy(), model.bias)
        self.bias = np.array([model.bias], np.float32)
        self.adam = {"e": _Adam(model.embed.shape, RATE), "o": _Adam(model.out.shape, RATE), "b": _Adam((1,), RATE)}
        for i, k in enumerate(model.kernels):
            self.adam[f"k{i}"], self.adam[f"s{i}"] = _Adam(k.shape, RATE), _Adam((FILTERS,), RATE)
        self.touches = np.zeros(len(model.embed), np.int32)
        self.t = self.rows = 0

    def step(self, batch: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        model, adam = self.model, self.adam
        self.t += 1
        self.rows += len(batch)
        best, spot = model.pooled(batch, places=True)
        hidden = np.maximum(best, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + self.bias[0], -50, 50)))
        d = ((p - labels) * weights / len(batch)).astype(np.float32)
        d_hidden = d[:, None] * model.out[None, :] * (best > 0)
        adam["o"].step(model.out, hidden.T @ d, self.t)
        adam["b"].step(self.bias, np.array([d.sum()], np.float32), self.t)
        touched, grads = [], []
        for i, w in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            doc, col = np.nonzero(d_hidden[:, cols])
            g = d_hidden[:, cols][doc, col]
            grad_k = np.zeros_like(model.kernels[i])
            for o in range(w):
                at_word = spot[:, cols][doc, col] + o
                ids = np.array([batch[n][s] if s < len(batch[n]) else 0 for n, s in zip(doc, at_word)], dtype=np.int64)
                x = model.rows(ids)
                np.add.at(grad_k[o * DIMS:(o + 1) * DIMS].T, col, x * g[:, None])
                back = model.kernels[i][o * DIMS:(o + 1) * DIMS].T[col] * g[:, None]
                touched += [ids >> 32, ids & 0xFFFFFFFF]
                grads += [back, back]
            grad_s = np.bincount(col, weights=g, minlength=FILTERS).astype(np.float32)
            adam[f"k{i}"].step(model.kernels[i], grad_k, self.t)
            adam[f"s{i}"].step(model.shifts[i], grad_s, self.t)
        rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        grad_e = np.zeros((len(rows), DIMS), np.float32)
        np.add.at(grad_e, inverse, np.concatenate(grads))
        if len(rows) and rows[0] == 0:
            rows, grad_e = rows[1:], grad_e[1:]
        adam["e"].step(model.embed, grad_e, self.t, rows)
        self.touches[rows] += 1

    def parts(self) -> pa.RecordBatch:
        """What is averaged: the touched embeddings by block, and the dense weights as one block more."""
        model, out = self.model, []
        for b in range(BUCKETS // BLOCK):
            n = self.touches[b * BLOCK:(b + 1) * BLOCK]
            at = np.flatnonzero(n).astype(np.int32)
            if len(at):
                out.append((b, at.tobytes(), n[at].tobytes(), model.embed[b * BLOCK + at].tobytes()))
        flat = np.concatenate([x.ravel() for x in (*model.kernels, *model.shifts, model.out, self.bias)]).astype(np.float32)
        zero = np.zeros(1, np.int32)
        out.append((BUCKETS // BLOCK, zero.tobytes(), (zero + self.rows).tobytes(), flat.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=_PARTS)


_PARTS = ["block", "at", "n", "weights"]
_PARTS_DDL = "block int, at binary, n binary, weights binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Averages of the copies' parts, weighed by touches; a block's sums are all that is held."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            at, n, w = np.frombuffer(row["at"], np.int32), np.frombuffer(row["n"], np.int32), np.frombuffer(row["weights"], np.float32)
            w = w.reshape(len(at), -1)
            total, count = sums.setdefault(row["block"], (np.zeros((BLOCK if w.shape[1] == DIMS else 1, w.shape[1])), np.zeros(BLOCK, np.int64)))
            total[at] += w * n[:, None].astype(np.float64)
            count[at] += n
    out = []
    for b, (total, count) in sums.items():
        at = np.flatnonzero(count).astype(np.int32)
        out.append((b, at.tobytes(), count[at].tobytes(), (total[at] / count[at][:, None]).astype(np.float32).tobytes()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=_PARTS)


def _averaged(model: Model, parts: list) -> Model:
    """``model`` with the averaged parts in place; embeddings that no copy touched stay."""
    embed, flat = model.embed.copy(), None
    for row in parts:
        at, w = np.frombuffer(row["at"], np.int32), np.frombuffer(row["weights"], np.float32)
        if row["block"] == BUCKETS // BLOCK:
            flat = w
        else:
            embed[row["block"] * BLOCK + at] = w.reshape(len(at), DIMS)
    ends = np.cumsum([x.size for x in (*model.kernels, *model.shifts, model.out)])
    cut = np.split(flat.copy(), ends)
    n = len(WIDTHS)
    return Model(embed, [c.reshape(k.shape) for c, k in zip(cut[:n], model.kernels)], cut[n:2 * n], cut[2 * n], float(cut[-1][0]))


def _unpacked(words: bytes) -> np.ndarray:
    ids = np.frombuffer(words, np.uint32).astype(np.int64)
    return (ids >> 16) << 32 | ids & 0xFFFF


def _word_rows(docs: DataFrame) -> DataFrame:
    """The rows (_n, _toxic, lang, text) with hashed words, 16 bits of the word and of its first letters, instead of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = remembered("toxicity", Words)
        for batch in batches:
            ids = [read(t) for t in batch.column(3).to_pylist()]
            packed = [((i >> 32) << 16 | i & 0xFFFF).astype(np.uint32).tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, type=pa.binary())], names=["_n", "_toxic", "lang", "words"])

    return docs.select("_n", "_toxic", "lang", "text").mapInArrow(run, "_n long, _toxic int, lang string, words binary")


def train(rows: DataFrame, counts: dict[int, int]) -> Model:
    """Fit on all ``rows`` (_n, _toxic, words), a written table; both classes, of ``counts`` rows, weigh the same.

    Rows are dealt to shards of about ``SHARD_ROWS`` by hash. In a round every shard goes once through its rows, in the order of
    another hash, starting from the average of the round before.
    """
    spark, total = rows.sparkSession, sum(counts.values())
    weigh = {k: 0.5 * total / max(n, 1) for k, n in counts.items()}
    shards = max(1, -(-total // SHARD_ROWS))
    model = new_model()
    for turn in range(max(ROUNDS, -(-EPOCHS // shards))):
        shared = spark.sparkContext.broadcast(model)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trainer, shard, waiting = None, None, []

            def learn():
                y = np.array([x[1] for x in waiting], np.float64)
                trainer.step([x[0] for x in waiting], y, np.array([weigh[x[1]] for x in waiting]))
                waiting.clear()

            for batch in batches:
                for s, y, words in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    if s != shard:
                        if waiting:
                            learn()
                        if trainer is not None:
                            yield trainer.parts()
                        trainer, shard = _Trainer(shared.value), s
                    waiting.append((_unpacked(words), y))
                    if len(waiting) == BATCH:
                        learn()
            if waiting:
                learn()
            if trainer is not None:
                yield trainer.parts()

        dealt = rows.select(F.pmod("_n", F.lit(shards)).alias("_shard"), "_toxic", "words", F.xxhash64("_n", F.lit(turn)).alias("_order"))
        copies = dealt.repartition(max(shards, 4 * parallelism(spark)), "_shard").sortWithinPartitions("_shard", "_order").drop("_order").mapInArrow(run, _PARTS_DDL)
        # the parts of one model
        model = _averaged(model, copies.repartition(BUCKETS // BLOCK + 1, "block").mapInArrow(_merge, _PARTS_DDL).collect())
        del dealt, copies
        shared.unpersist()
        release(spark)
    return model


def _logits(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (_toxic, lang, words) as _toxic, lang, x (the logit)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.logits([_unpacked(w) for w in batch.column(2).to_pylist()]).astype(np.float64) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x)], names=["_toxic", "lang", "x"])

    return rows.select("_toxic", "lang", "words").mapInArrow(run, "_toxic int, lang string, x double")


def _logistic(scale: float, offset: float):
    return 1 / (1 + F.exp(-F.greatest(F.least(F.col("x") * scale + offset, F.lit(50.0)), F.lit(-50.0))))


def calibrate(model: Model, logits: DataFrame) -> None:
    """Platt scaling: scale and offset of the ``logits`` (_toxic, x), a written table, that fit all labels best, by Newton steps."""
    n1, n0 = logits.agg(F.coalesce(F.sum("_toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("_toxic")), F.lit(0))).first()
    if not n1 or not n0:
        return
    # a little weight of both answers keeps separable labels finite
    y = F.when(F.col("_toxic") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    b, x = np.array([1.0, np.log(n1 / n0)]), F.col("x")
    for _ in range(50):
        p = F.col("p")
        s = logits.withColumn("p", _logistic(float(b[0]), float(b[1]))).withColumns({"d": p - y, "v": p * (1 - p)}).agg(
            F.sum(x * F.col("d")), F.sum("d"), F.sum(x * x * F.col("v")), F.sum(x * F.col("v")), F.sum("v")
        ).first()
        g = np.array([s[0], s[1]]) + 1e-6 * b
        h = np.array([[s[2], s[3]], [s[3], s[4]]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if b[0] > 0:
        model.scale, model.offset = float(b[0]), float(b[1])


def thresholds(model: Model, logits: DataFrame) -> dict[str, float]:
    """Per language the threshold of the best F1 on all ``logits`` (_toxic, lang, x): the middle of the gap around it.

    Rows are counted per bin of the score, so a language is at most ``SCORE_BINS`` + 1 rows where it is sorted.
    """
    scored = logits.where("lang is not null").withColumn("s", _logistic(model.scale, model.offset))
    bins = scored.groupBy("lang", F.floor(F.col("s") * SCORE_BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_toxic").alias("hits"), F.min("s").alias("low"), F.max("s").alias("high")
    )
    one, down = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("bin"))
    sums = bins.select(
        "*", F.sum("hits").over(down).alias("hit"), F.sum("n").over(down).alias("all"), F.lead("high", 1, 0.0).over(down).alias("below"),
        F.sum("hits").over(one).alias("ones"), F.sum(F.col("n") - F.col("hits")).over(one).alias("zeros"),
    ).where(F.least("ones", "zeros") >= LANGUAGE_ROWS)
    best = sums.groupBy("lang").agg(F.max(F.struct((2 * F.col("hit") / (F.col("all") + F.col("ones"))).alias("f1"), "bin", "low", "below")).alias("b")).collect()
    return {r["lang"]: float(min(max((r["b"]["low"] + r["b"]["below"]) / 2, 0.1), 0.9)) for r in best}


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, float]]:
    """Model and thresholds from all labelled rows outside the held-out slot.

    A fifth of the rows, by a hash of the id, calibrates; the others are trained on. Where a class has fewer than 50 rows,
    all are trained on and calibrate. Without labels of both classes the
    model is untrained and its score stays below the threshold.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_toxic in (0, 1)")
    usable = usable.where(F.col("_id").isNotNull() & (crc_slot("_id", HELD_OUT_OF) != HELD_OUT)).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    known = docs.select("doc_id", F.struct(text_of().alias("text"), F.col("lang").cast("string").alias("lang")).alias("doc")).join(
        usable.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")
    )
    # a repeated id counts once; the rows lie by id already
    known = known.groupBy("doc_id").agg(F.min("doc").alias("doc"), F.min("_toxic").alias("_toxic")).select(F.xxhash64("doc_id").alias("_n"), "_toxic", "doc.lang", "doc.text")
    rows = settle(_word_rows(known), "labelled-words")
    del known
    release(docs.sparkSession)  # the texts that met their labels
    held = F.pmod(F.shiftright("_n", 32), F.lit(5)) == 0
    counts = {(r["_toxic"], r["held"]): r["n"] for r in rows.groupBy("_toxic", held.alias("held")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {k: counts.get((k, False), 0) + counts.get((k, True), 0) for k in (0, 1)}
    if not all(sizes.values()):
        model = new_model()
        model.scale, model.offset = 0.0, -4.0
        return model, {}
    part = min(sizes.values()) >= 50 and all(counts.get((k, h), 0) for k in (0, 1) for h in (False, True))
    model = train(rows.where(~held) if part else rows, {k: counts[k, False] for k in (0, 1)} if part else sizes)
    logits = settle(_logits(rows.where(held) if part else rows, model), "calibration")
    calibrate(model, logits)
    return model, thresholds(model, logits)


def score(docs: DataFrame, model: Model, limits: dict[str, float], carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` columns with score, predicted (at ``THRESHOLD``), threshold of the language and rejected (at that).

    The column ``text`` goes to Python once, whether it is carried or not.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, read = shared.value, remembered("toxicity", Words)
        for batch in batches:
            texts = batch.column(place)
            scores = np.zeros(batch.num_rows)
            held, size, at = [], 0, 0
            for i in range(batch.num_rows):
                held.append(read(texts[i].as_py() or ""))
                size += len(held[-1])
                if size >= CHUNK or i + 1 == batch.num_rows:
                    scores[at:i + 1] = net.scores(held)
                    held, size, at = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(scores)], names=[*batch.schema.names[:kept], "score"])

    read_rows = docs.select(*carry, *([] if text in carry else [text]))
    kept, place = len(carry), read_rows.columns.index(text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read_rows.schema.fields[:kept]) + ", score double"
    pairs = [F.lit(x) for item in sorted(limits.items()) for x in item]
    limit = F.coalesce(F.create_map(*pairs)[F.col("lang")], F.lit(THRESHOLD)) if pairs else F.lit(THRESHOLD)
    return read_rows.mapInArrow(run, ddl).withColumns({
        "predicted": F.when(F.col("score") >= THRESHOLD, 1).otherwise(0),
        "threshold": limit,
    }).withColumn("rejected", F.col("score") >= F.col("threshold"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted, lang, threshold, rejected.

    A null text is scored as the empty one; repeated rows are scored alike; of several labels of an id the
    larger counts, null labels and labels without a document do not; other columns are not read.
    """
    model, limits = fit(docs, labels)
    return score(docs, model, limits, ["doc_id", "lang"]).withColumn("held_out", crc_slot("doc_id", HELD_OUT_OF) == HELD_OUT)


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier trained on the labels."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not rejected."""
    model, limits = fit(docs, table(spark, sf_dir, "labels"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    kept = kept.withColumn("lang", F.col(names[docs.columns.index("lang")]))
    return score(kept, model, limits, [*names, "lang"], names[docs.columns.index("text")]).where(~F.col("rejected")).select(
        *[F.col(n).alias(c) for n, c in zip(names, docs.columns)]
    )
