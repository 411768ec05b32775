"""Best-fit packing planned on a length histogram.

Documents become runs of token ids, cut only where longer than a sequence. The
plan is made on the counts of the lengths, a table of at most ``capacity`` rows
whatever the corpus: best-fit-decreasing places whole counts into groups of
equally filled sequences. Each piece then takes its planned slot by its rank
within its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm.common import bounded_batches, rank_within, table, text_of
from priceloom.llm.tokens import remembered

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
# A Python worker remembers this many words and stems that it met last, and as many before them.
MEMORY_WORDS = 400_000
# Texts are encoded together up to this many bytes.
TOGETHER_BYTES = 8 << 20
# Marks that the tokenizer always parts from a letter or digit before them.
_MARKS = b".,!"


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _recall(memory: dict, older: dict, wanted: set) -> list[bytes]:
    """Bring what is remembered of ``wanted`` into ``memory``; returns the rest."""
    rest = []
    for w in wanted.difference(memory):
        known = older.get(w)
        if known is None:
            rest.append(w)
        else:
            memory[w] = known
    return rest


def _stem(w: bytes) -> bytes:
    stem = w.rstrip(_MARKS)
    return stem if stem and len(stem) < len(w) and (stem[-1:].isalnum() or stem.decode().lower()[-1].isalpha()) else w


def encode(texts: pa.Array, path: str, tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``texts`` (no nulls) one after another as unsigned 32-bit integers, and the number of ids of each.

    The tokenizer never joins across white space and lower-cases, so a text is the join of its
    lower-cased words, and a word is its stem and the marks that end it. Arrow tells the distinct words of
    a batch apart; a worker encodes a stem once while it remembers it, and numpy gathers the ids. Words are split at ASCII
    white space only; whatever else the tokenizer treats as space stays inside a word. Texts
    that may spell a special token keep their case.
    """
    memory = remembered(f"ids of {path}", lambda: [{}, {}, {}, {}])
    for now in (0, 2):
        if len(memory[now]) > MEMORY_WORDS:
            memory[now], memory[now + 1] = {}, memory[now]
    words, old_words, stems, old_stems = memory
    split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = split.flatten().dictionary_encode()
    spelled = distinct.dictionary.cast(pa.binary()).to_pylist()
    new = {w: _stem(w) for w in _recall(words, old_words, set(spelled))}
    parts = set(new.values())
    parts.update(w[len(stem):] for w, stem in new.items() if len(stem) < len(w))
    missing = _recall(stems, old_stems, parts)
    for at in range(0, len(missing), 4096):
        part = missing[at:at + 4096]
        lists = [e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)]
        flat = array("I", chain.from_iterable(lists)).tobytes()
        cuts = [0, *accumulate(4 * len(ids) for ids in lists)]
        stems.update(zip(part, [flat[i:j] for i, j in zip(cuts, cuts[1:])]))
    for w, stem in new.items():
        words[w] = stems[stem] if len(stem) == len(w) else stems[stem] + stems[w[len(stem):]]
    found = list(map(words.__getitem__, spelled))
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(lengths) - lengths
    codes = distinct.indices.to_numpy(zero_copy_only=False)
    counts = lengths[codes]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(starts[codes] - ends + counts, counts) + np.arange(total)]
    per_text = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])
    return ids, per_text


def encoded(texts: list[bytes], path: str, tokenizer) -> list[bytes]:
    """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
    ids, counts = encode(pa.array(texts, pa.binary()).cast(pa.string()), path, tokenizer)
    return [c.tobytes() for c in np.split(ids, np.cumsum(counts)[:-1])]


def _together(lengths: list[int]) -> Iterator[slice]:
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > TOGETHER_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if lengths:
        yield slice(start, len(lengths))


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    ``docs`` has doc_id and text. A document's ids end with ``END_ID``, so a null or
    empty text is one piece of one id. Only documents longer than ``capacity`` are cut.
    """
    bounded_batches(docs.sparkSession)
    path = path or tokenizer_path()
    fields = [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ] + ([("ids", pa.list_(pa.int64()))] if with_ids else [])
    schema = pa.schema(fields)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for part in _together(pc.binary_length(texts).to_pylist()):
                ids, counts = encode(texts[part], path, tokenizer)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, END_ID).astype("<u4", copy=False)
                rows, start = [], 0
                for doc_id, n in zip(doc_ids[part], (counts + 1).tolist()):
                    for i, at in enumerate(range(0, n, capacity)):
                        cut = ids[start + at:start + min(at + capacity, n)]
                        row = (doc_id, i, at, len(cut), zlib.crc32(cut))
                        rows.append((*row, cut.astype(np.int64)) if with_ids else row)
                    start += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                )

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, ddl)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing over counts: (length, first rank, end rank, first sequence, offset).

    Pieces of a length ranked in [first, end) go to consecutive sequences from
    ``first sequence``, each at ``offset``. Open sequences are kept as groups of equal
    room; one step fills a part of a group, so the plan has a few entries per
    length, however many pieces there are.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, count) groups
    slots, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            best = min((r for r, groups in room.items() if r >= length and groups), default=None)
            if best is None:
                # new sequences; each takes as many of this length as fit, so the last few may be part filled
                fit = capacity // length
                full, rest = divmod(left, fit)
                for j in range(fit if full else 0):
                    slots.append((length, rank, rank + full, fresh, j * length))
                    rank += full
                if full and capacity - fit * length:
                    room.setdefault(capacity - fit * length, []).append((fresh, full))
                fresh += full
                for j in range(rest):
                    slots.append((length, rank, rank + 1, fresh, j * length))
                    rank += 1
                if rest:
                    if capacity - rest * length:
                        room.setdefault(capacity - rest * length, []).append((fresh, 1))
                    fresh += 1
                left = 0
                continue
            first, count = room[best].pop()
            used = min(count, left)
            slots.append((length, rank, rank + used, first, capacity - best))
            if used < count:
                room[best].append((first + used, count - used))
            if best > length:
                room.setdefault(best - length, []).append((first, used))
            rank, left = rank + used, left - used
    return slots


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence_id and offset; ``cut`` is a written table of pieces.

    The histogram brought to the driver has at most ``capacity`` rows and the plan a
    few per length: both are bounded by the sequence length, not by the corpus.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(counts, capacity), "_length long, _first long, _end long, _sequence long, _offset long"
    )
    ranked = rank_within(cut, ["length"], ["doc_id", "piece"], rank="_rank")
    taken = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    return ranked.join(F.broadcast(slots), taken).select(
        *cut.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset")
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(settle(pieces(table(spark, sf_dir, "documents")), "pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of every document with their places; copies of a document are packed one by one."""
    return pack(settle(pieces(docs), "pieces"))
