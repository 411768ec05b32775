"""Vector codes by per-dimension value dictionaries.

Vectors become integers. Rows are written in blocks; a block keeps, per dimension, the
sorted distinct integers (the dictionary) and the place of every row's integer in it (the codes). A round
tabulates, per dimension, the squared difference of every distinct integer to that dimension of all codebook entries;
the distances of a part are then gathers from these tables by the codes, added over the part's dimensions.
Sums and counts of the entries leave each task once; the codebook, which is bounded by its
entries, is all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import join_lookup, settle
from priceloom.llm.common import empty, parallelism, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Rows of a block, fewer where vectors are long; distances are held for this many rows at a time.
BLOCK_ROWS = 8192
BLOCK_BYTES = 16 << 20
CHUNK_ROWS = 1024
_LONG = 2**63 - 1
BLOCK = "vec_ids array<long>, labels array<string>, sizes array<int>, dictionaries binary, codes binary"


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label_key (text, never null), v (scaled components, before the floor) of the rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.to_json(F.struct(F.col("label"))).alias("label_key"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Rows packed into blocks of dictionaries and codes; shorter vectors count as zero in the dimensions they lack."""
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dims, 1))))
    schema = pa.schema([
        ("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())),
        ("dictionaries", pa.binary()), ("codes", pa.binary()),
    ])

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False))
        lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        whole = np.zeros((batch.num_rows, dims))
        whole[np.arange(dims) < lengths[:, None]] = flat
        whole += 0.0  # one zero, not two
        sizes, values = [], []
        codes = np.empty((dims, batch.num_rows), dtype=np.uint16)
        for d in range(dims):
            distinct, codes[d] = np.unique(whole[:, d], return_inverse=True)
            sizes.append(len(distinct))
            values.append(distinct)
        return pa.RecordBatch.from_arrays([
            pa.array([batch.column(0).to_pylist()], schema.field(0).type), pa.array([batch.column(1).to_pylist()], schema.field(1).type),
            pa.array([sizes], schema.field(2).type), pa.array([np.concatenate(values).tobytes() if values else b""], pa.binary()),
            pa.array([codes.tobytes()], pa.binary()),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            while rows_held >= size:
                joined = pa.Table.from_batches(held).combine_chunks()
                yield pack(joined.slice(0, size).combine_chunks().to_batches()[0])
                rest = joined.slice(size)
                held, rows_held = rest.to_batches(), rest.num_rows
        if rows_held:
            yield pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.select("vec_id", "label_key", "v").mapInArrow(run, BLOCK)


class _Block:
    """One block read back: row ids, labels, dictionaries per dimension, codes."""

    def __init__(self, batch: pa.RecordBatch, i: int, dims: int) -> None:
        self.vec_ids, self.labels = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        self.rows = len(self.vec_ids)
        values = np.frombuffer(batch.column(3)[i].as_py(), dtype=np.float64)
        self.values = np.split(values, np.cumsum(batch.column(2)[i].as_py())[:-1]) if dims else []
        self.codes = np.frombuffer(batch.column(4)[i].as_py(), dtype=np.uint16).reshape(dims, self.rows)
        self.most = float(np.abs(values).max(initial=0.0))


def _number_type(most: float, width: int):
    """The narrowest exact type for sums of ``width`` squared differences of integers up to ``most``."""
    reach = 4.0 * most * most * max(width, 1)
    return np.int32 if reach < 2**30 else np.int64 if reach < 2**62 else object


def _exact(values: np.ndarray, kind) -> np.ndarray:
    return np.array([int(x) for x in values], dtype=object) if kind is object else values.astype(kind)


def _edges(dims: int) -> list[int]:
    return [p * dims // PARTS for p in range(PARTS + 1)]


def _assign(block: _Block, codebook: list[list[list[int]]], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (parts x rows) and its squared distance; equal distances go to the lower entry."""
    edges = _edges(dims)
    nearest = np.zeros((PARTS, block.rows), dtype=np.int64)
    least = np.zeros((PARTS, block.rows), dtype=object)
    for p in range(PARTS):
        width = edges[p + 1] - edges[p]
        most = max([block.most, *(abs(x) for entry in codebook[p] for x in entry)])
        kind = _number_type(float(most), width)
        entries = np.array(codebook[p], dtype=kind).reshape(len(codebook[p]), width)
        tables = []
        for d in range(width):
            apart = _exact(block.values[edges[p] + d], kind)[:, None] - entries[:, d][None, :]
            tables.append(apart * apart)
        for start in range(0, block.rows, CHUNK_ROWS):
            part = slice(start, min(start + CHUNK_ROWS, block.rows))
            total = np.zeros((part.stop - start, len(entries)), dtype=kind)
            for d in range(width):
                total += tables[d][block.codes[edges[p] + d, part]]
            nearest[p, part] = total.argmin(axis=1)
            least[p, part] = total[np.arange(len(total)), nearest[p, part]]
    return nearest, least


def _sums(blocks: DataFrame, codebook: list, dims: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Per part and entry in use: how many parts it has and their sum. Numbers travel as text, exact at any size."""
    edges = _edges(dims)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.string())])

    def rows_of(held: dict) -> pa.RecordBatch:
        keys = sorted(held)
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([held[k][0] for k in keys], pa.int64()), pa.array([",".join(map(str, held[k][1])) for k in keys], pa.string()),
        ], schema=schema)

    def reduce_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, dims)
                nearest, _ = _assign(block, codebook, dims)
                for p in range(PARTS):
                    width = edges[p + 1] - edges[p]
                    counts = np.bincount(nearest[p], minlength=len(codebook[p]))
                    kind = object if block.most * block.rows >= 2**62 else np.int64
                    total = np.zeros((len(counts), width), dtype=kind)
                    for d in range(width):
                        values = _exact(block.values[edges[p] + d], kind)
                        np.add.at(total[:, d], nearest[p], values[block.codes[edges[p] + d]])
                    for e in np.nonzero(counts)[0].tolist():
                        _add(held, (p, e), int(counts[e]), total[e].tolist())
        yield rows_of(held)

    def reduce_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for p, e, n, total in zip(*[c.to_pylist() for c in batch.columns]):
                _add(held, (p, e), n, [int(x) for x in total.split(",")] if total else [])
        yield rows_of(held)

    ddl = "part int, entry int, n long, total string"
    partial = blocks.mapInArrow(reduce_blocks, ddl)
    summed = partial.repartition(min(PARTS * ENTRIES, parallelism(blocks.sparkSession)), "part", "entry").mapInArrow(reduce_sums, ddl)
    return {(r["part"], r["entry"]): (r["n"], [int(x) for x in r["total"].split(",")] if r["total"] else []) for r in summed.collect()}


def _add(held: dict, key: tuple[int, int], n: int, total: list[int]) -> None:
    if key in held:
        held[key] = (held[key][0] + n, [a + b for a, b in zip(held[key][1], total)])
    else:
        held[key] = (n, total)


def codebooks_of(blocks: DataFrame, first: list[list[int]], dims: int, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks (part, entry, component) after ``rounds`` rounds from the vectors ``first``."""
    edges = _edges(dims)
    codebook = [[v[edges[p]:edges[p + 1]] for v in first] for p in range(PARTS)]
    for _ in range(rounds):
        for (p, e), (n, total) in _sums(blocks, codebook, dims).items():
            codebook[p][e] = [x // n for x in total]
    return codebook


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, code, error, label_error of every row that takes part, and the final codebooks.

    ``vectors`` has vec_id, embedding and label. Rows whose vector is null or holds a null or
    non-finite component (also one that overflows when scaled) take no part; an empty vector and the missing components of shorter
    vectors count as zeros; with a width that four does not divide, part p starts at floor(p * width / 4).
    Repeated rows count each; null ids come last among the first entries; equal ids are ordered by their
    vectors. An error beyond a long is null, and so is the label_error that holds it. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = settle(_usable(vectors), "usable-vectors")
    dims = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    first = [
        [int(np.floor(x)) for x in r["v"]] + [0] * (dims - len(r["v"]))
        for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    ]
    if not first:
        return empty(spark, "vec_id long, code string, error long, label_error long"), [[] for _ in range(PARTS)]
    blocks = settle(_blocks(rows, dims), "blocks")
    codebook = codebooks_of(blocks, first, dims, rounds)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, dims)
                nearest, least = _assign(block, codebook, dims)
                codes = nearest.T.astype(np.uint8).tobytes().hex()
                errors = [e if e <= _LONG else None for e in map(int, least.sum(axis=0).tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.vec_ids, pa.int64()), pa.array(block.labels, pa.string()),
                    pa.array([codes[2 * PARTS * k:2 * PARTS * (k + 1)] for k in range(block.rows)], pa.string()), pa.array(errors, pa.int64()),
                ], names=["vec_id", "label_key", "code", "error"])

    coded = settle(blocks.mapInArrow(finish, "vec_id long, label_key string, code string, error long"), "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count_if(F.col("error").isNull()) == 0) & (total <= F.lit(_LONG))
    by_label = coded.groupBy("label_key").agg(F.when(fits, total).cast("long").alias("label_error"))
    return join_lookup(coded, by_label, ["label_key"]).select("vec_id", "code", "error", "label_error"), codebook


def digest(codebook: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for part in codebook for entry in part for x in entry).encode()).hexdigest()


def decoded(coded: DataFrame, codebook: list[list[list[int]]]) -> DataFrame:
    """vec_id, approximation (array of doubles): the vectors that the codes stand for, on the original scale."""
    books = [np.array(part, dtype=np.float64) / SCALE for part in codebook]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), dtype=np.uint8).reshape(-1, PARTS)
            rows = np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], names=["vec_id", "approximation"])

    return coded.select("vec_id", "code").mapInArrow(run, "vec_id long, approximation array<double>")


def op11_value_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and the codebooks' digest of all embeddings."""
    coded, codebook = compress(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(digest(codebook)))


def _oracle() -> str:
    """The rounds unrolled as one query."""
    sql = [f"""
WITH RECURSIVE raw AS (
  SELECT vec_id, label, list_transform(embedding, lambda x : CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS w FROM raw, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w FROM parts
  QUALIFY e < {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        sql.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, label, x.p, min((list_inner_product(x.w, x.w) - 2 * list_inner_product(x.w, c.w) + list_inner_product(c.w, c.w)) * {ENTRIES} + e) AS best, any_value(x.w) AS w
  FROM parts x JOIN c{k} c USING (p) GROUP BY vec_id, label, x.p)""")
        if k < ROUNDS:
            sql.append(f"""
s{k} AS (SELECT p, CAST(best AS BIGINT) % {ENTRIES} AS e, i, floor(sum(w[i + 1]) / count(*)) AS m FROM a{k}, range(4096) r(i) WHERE i < len(w) GROUP BY 1, 2, 3),
m{k} AS (SELECT p, e, list(m ORDER BY i) AS w FROM s{k} GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.w, c.w) AS w FROM c{k} c LEFT JOIN m{k} m USING (p, e))""")
    sql.append(f"""
final AS (SELECT vec_id, label, p, CAST(best AS BIGINT) // {ENTRIES} AS d, CAST(best AS BIGINT) % {ENTRIES} AS e FROM a{ROUNDS}),
coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY 1, 2),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x : CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book""")
    return ",".join(sql)


ORACLE = _oracle()
