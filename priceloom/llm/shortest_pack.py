"""Shortest-pack-first packing planned on a length histogram.

Every document becomes a run of ids, cut into full sequences and a rest. The plan
is made on the counts of the lengths: lengths are placed longest first, each into the
shortest open packs that have room, whole groups of equal packs at a time, so that a
packing pattern is a count of equal packs. Pieces take their place in a pattern by joining on their rank within
their length. Documents may be cut anywhere: the emptiest packs are taken apart, and their
pieces fill the room that the other packs have left; what remains after that goes into sequences of
powers of two. No sequence is padded.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm.byte_tokens import encode
from priceloom.llm.common import bounded_batches, rank_within, table, text_of

CAPACITY = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
# Texts are encoded together up to this many bytes.
TOGETHER_BYTES = 8 << 20
PIECES = "row long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per full sequence or rest of a document: row, doc_id, start, length, doc_tokens, ids_crc32, ids.

    ``row`` is a number of the piece that is written with it. ``ids`` (unsigned 32-bit, little
    endian) are those of rests; full sequences keep their checksum only. Ids end with ``end_id``,
    so a null or empty text has one id. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    path = path or tokenizer_path()
    schema = pa.schema([(f.split()[0], pa.binary() if f.split()[1] == "binary" else pa.int64()) for f in PIECES.split(", ")])
    end = np.asarray([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for part in _slices(lengths):
                ids, counts = encode(texts[part], path)
                rows, at = [], 0
                for doc_id, n in zip(doc_ids[part], counts.tolist()):
                    run_of = np.concatenate([ids[at:at + n], end]).astype("<u4", copy=False)
                    at += n
                    for start in range(0, n + 1, capacity):
                        cut = run_of[start:start + capacity]
                        kept = cut.tobytes() if len(cut) < capacity else None
                        rows.append((number, doc_id, start, len(cut), n + 1, zlib.crc32(cut), kept))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES)


def _slices(lengths: np.ndarray) -> Iterator[slice]:
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > TOGETHER_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if len(lengths):
        yield slice(start, len(lengths))


@dataclass
class Plan:
    """Places of all pieces.

    ``slots``: length, first rank, end rank, sequence (or -1), offset, line, step. The piece of rank r in a slot is
    in ``sequence + r - first`` at ``offset``; with sequence -1 it is to be cut and lies on the line of loose ids from
    ``line + (r - first) * step``. ``rooms``: line, end, sequence, offset, size; the loose ids from ``line`` fill
    ``size`` places of one sequence after another from ``offset`` on.
    """

    slots: list[tuple[int, int, int, int, int, int, int]]
    rooms: list[tuple[int, int, int, int, int]]
    sequences: int


def patterns(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Shortest-pack-first: slots (length, first rank, end rank, first pack, offset) and groups of packs (first, count, fill).

    Where no open pack has room, new packs are opened, each with as many pieces of the length as fit.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # fill -> groups of equal packs (first pack, count)
    fills: list[int] = []
    slots, packs = [], 0

    def put(fill: int, first: int, count: int) -> None:
        if count:
            if fill not in open_:
                open_[fill] = []
                heapq.heappush(fills, fill)
            open_[fill].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while fills and not open_[fills[0]]:
                del open_[heapq.heappop(fills)]
            if fills and fills[0] + length <= capacity:
                fill = fills[0]
                first, count = open_[fill].pop()
                used = min(count, left)
                slots.append((length, rank, rank + used, first, fill))
                put(fill + length, first, used)
                put(fill, first + used, count - used)
                rank, left = rank + used, left - used
                continue
            fit = capacity // length
            full, rest = divmod(left, fit)
            for count, deep in ((full, fit), (1 if rest else 0, rest)):
                for j in range(deep if count else 0):
                    slots.append((length, rank, rank + count, packs, j * length))
                    rank += count
                put(deep * length, packs, count)
                packs += count
            left = 0
    return slots, [(first, count, fill) for fill, groups in open_.items() for first, count in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Places of the pieces of a histogram; its size is bounded by the capacity, whatever the counts."""
    slots, groups = patterns(histogram, capacity)
    total = sum(length * n for length, n in histogram.items())
    keep, rest = divmod(total, capacity)
    placed, rooms, loose, room, sequence = [], [], 0, 0, 0
    for first, count, fill in sorted(groups, key=lambda g: (-g[2], g[0])):
        kept = min(count, keep - sequence)
        if kept:
            placed.append((first, first + kept, fill, sequence, -1))
            if fill < capacity:
                rooms.append((room, room + kept * (capacity - fill), sequence, fill, capacity - fill))
                room += kept * (capacity - fill)
            sequence += kept
        if kept < count:
            placed.append((first + kept, first + count, fill, -1, loose))
            loose += (count - kept) * fill
    for bit in range(capacity.bit_length(), -1, -1):
        size = 1 << bit
        if rest & size:
            rooms.append((room, room + size, sequence, 0, size))
            room, sequence = room + size, sequence + 1
    assert room == loose, "the rooms hold all loose ids"
    placed.sort()
    starts = [p[0] for p in placed]
    final = []
    for length, rank, end, pack, offset in slots:
        i = int(np.searchsorted(starts, pack, "right")) - 1
        while rank < end:
            first, stop, fill, at, line = placed[i]
            used = min(end - rank, stop - pack)
            if at >= 0:
                final.append((length, rank, rank + used, at + pack - first, offset, 0, 0))
            else:
                final.append((length, rank, rank + used, -1, 0, line + (pack - first) * fill + offset, fill))
            rank, pack, i = rank + used, pack + used, i + 1
    return Plan(final, rooms, sequence)


def _fill_rooms(loose: DataFrame, rooms: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Cut pieces (doc_id, start, doc_tokens, ids, line) at the edges of the rooms they fall into."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    arrow = pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")])
    bounds = np.asarray(rooms, dtype=np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, start, doc_tokens, ids, line in zip(*[c.to_pylist() for c in batch.columns]):
                at, end = 0, len(ids) // 4
                i = int(np.searchsorted(bounds[:, 0], line, "right")) - 1
                while at < end:
                    first, stop, sequence, offset, size = bounds[i].tolist()
                    nth, inside = divmod(line + at - first, size)
                    used = min(end - at, size - inside)
                    cut = ids[4 * at:4 * (at + used)]
                    rows.append((doc_id, start + at, used, zlib.crc32(cut), doc_tokens, sequence + nth, offset + inside))
                    at += used
                    if line + at >= stop:
                        i += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], schema=arrow)

    return loose.select("doc_id", "start", "doc_tokens", "ids", "_line").mapInArrow(run, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of the final pieces of ``cut`` (written ``pieces``).

    The histogram has at most ``capacity`` rows, and slots and rooms are bounded by the capacity alone; they are
    what the driver holds and what is broadcast. Ids move only for the lengths that have pieces to be cut.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(counts, capacity)
    slots = spark.createDataFrame(
        made.slots, "_length long, _first long, _end long, _sequence long, _offset long, _from long, _step long"
    )
    opened = sorted({s[0] for s in made.slots if s[3] < 0})
    narrow = cut.withColumn("ids", F.when(F.col("length").isin(opened), F.col("ids")) if opened else F.lit(None).cast("binary"))
    taken = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    ranked = rank_within(narrow, ["length"], ["row"], rank="_rank").join(F.broadcast(slots), taken)
    nth = F.col("_rank") - F.col("_first")
    places = settle(ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_sequence") + nth).alias("sequence_id"), F.col("_offset").alias("offset"),
        (F.col("_sequence") < 0).alias("_loose"), F.when(F.col("_sequence") < 0, F.col("ids")).alias("ids"),
        (F.col("_from") + nth * F.col("_step")).alias("_line"),
    ), "places")
    whole = places.where("not _loose").drop("_loose", "ids", "_line")
    return whole.unionByName(_fill_rooms(places.where("_loose"), made.rooms)) if made.rooms else whole


def op13_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(settle(pieces(table(spark, sf_dir, "documents")), "pieces"))
