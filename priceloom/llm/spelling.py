"""Spelling variants by permuterm rotations.

Every word gets a terminator, and all its rotations are sorted. A word x c y has
a rotation that ends in c and begins with y, the terminator and x: words that differ in c alone share this
prefix of the rotation, and the rotation of x y that is as long as the prefix is the word without c. The
sort key is therefore the rotation without its last, edited character (or the whole rotation, for the word that lacks one), and a scan
meets replacements and indels side by side. A group has at most one word per letter and one without, whatever the
corpus. The scan emits, per word of a group, how many neighbours it has there and the best of them, not
the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import join_lookup, settle
from priceloom.llm.common import ascii_lower, bounded_batches, parallelism, table, text_of

#: Letters of a run after A-Z are lower-cased.
LETTERS = r"a-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent as its variants.
RATIO = 10
#: A run whose checksum this number divides loses a letter.
SLIP = 31
END = "$"
# Rotations of up to so many letters are sorted as text, longer ones by a digest of the text.
TEXT_KEY = 256
# Digests are polynomials modulo this prime (a Mersenne prime), at two fixed points.
PRIME = 2**89 - 1
POINTS = (0x1F3D5B79A2C4E68B13579B, 0x0123CAFE4567BEEF89ABCD)
BATCH_ROWS = 8192


def words(docs: DataFrame, slip: int = SLIP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the distinct words of whole texts with their occurrences.

    Runs of letters are lower-cased in A-Z only; a run loses one letter where ``slip`` divides the
    checksum of its document's id (empty where null) and itself. Counting is combined before the shuffle, so a
    frequent word is no hot key. Shorter runs cannot become words and are left out by the pattern.
    """
    runs = F.regexp_extract_all(ascii_lower(text_of()), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "_id", "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, _at)"), F.expr("substring(run, _at + 2)"))
    word = F.when(F.col("_h") % slip == 0, cut).otherwise(F.col("run"))
    found = run.withColumn("_h", h).withColumn("_at", at).select(word.alias("word"))
    return found.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def rotation_keys(word: str) -> Iterator[tuple[str, int]]:
    """Sort key of each rotation with the role of the word there.

    Role 0: the word has an edited letter after the key; 1: as 0, and it is the first of a run of equal letters, where
    it meets the word without the letter (once, not once per equal letter); 2: the word lacks the letter.
    """
    if len(word) <= TEXT_KEY:
        for i, c in enumerate(word):
            yield word[i + 1:] + END + word[:i], 0 if i and word[i - 1] == c else 1
    else:
        for i, key in enumerate(_digests(word, 1)):
            yield key, 0 if i and word[i - 1] == word[i] else 1
    if len(word) < TEXT_KEY:
        for i in range(len(word) + 1):
            yield word[i:] + END + word[:i], 2
    else:
        for key in _digests(word, 0):
            yield key, 2


def _digests(word: str, skipped: int) -> Iterator[str]:
    """Digests of the rotations of a long word in one pass: from the polynomials of its beginnings."""
    letters = [ord(c) + 1 for c in word]
    n = len(letters)
    heads, powers = [], []
    for x in POINTS:
        head, power, h, p = [0], [1], 0, 1
        for c in letters:
            h, p = (h * x + c) % PRIME, p * x % PRIME
            head.append(h)
            power.append(p)
        heads.append(head)
        powers.append(power)
    for i in range(n + 1 - skipped):
        found = []
        for x, head, power in zip(POINTS, heads, powers):
            rest = (head[n] - head[i + skipped] * power[n - i - skipped]) % PRIME
            found.append(((rest * x + ord(END) + 1) * power[i] + head[i]) % PRIME)
        yield f"{END}{n + 1 - skipped}:" + ":".join(f"{f:x}" for f in found)


def _rotations(counted: DataFrame) -> DataFrame:
    """key, role, word, n of all rotations."""
    schema = pa.schema([("key", pa.string()), ("role", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, roles, spelled, counts, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((keys, roles, spelled, counts), schema)], schema=schema)

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key, role in rotation_keys(word):
                    keys.append(key)
                    roles.append(role)
                    spelled.append(word)
                    counts.append(n)
                    size += len(key) + len(word)
                    if size > 4 << 20:
                        yield out()
                        keys, roles, spelled, counts, size = [], [], [], [], 0
        if keys:
            yield out()

    return counted.select("word", "n").mapInArrow(run, "key string, role int, word string, n long")


def _scan(rotations: DataFrame, ratio: int) -> DataFrame:
    """word, n, near, form_n, form: per rotation with neighbours, their number and the best that can be a form."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def of(group: list[tuple[int, str, int]]) -> Iterator[tuple]:
        # most frequent first, then by code points
        group.sort(key=lambda m: (-m[2], m[1]))
        firsts = sum(role == 1 for role, _, _ in group)
        longer = sum(role < 2 for role, _, _ in group)
        lacking = len(group) - longer
        for role, word, n in group:
            near = firsts if role == 2 else longer - 1 + (lacking if role == 1 else 0)
            if not near:
                continue
            best = next((m for m in group if m[1] != word and _meet(role, m[0])), None)
            chosen = best if best[2] >= ratio * n else (None, None, None)
            yield word, near, chosen[2], chosen[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, current, out = [], None, []
        for batch in batches:
            for key, role, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                if key != current:
                    if len(group) > 1:
                        out.extend(of(group))
                    group, current = [], key
                group.append((role, word, n))
            if len(out) > BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if len(group) > 1:
            out.extend(of(group))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    dealt = rotations.repartition(parallelism(rotations.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, near long, form_n long, form string")


def _meet(one: int, other: int) -> bool:
    """Whether words with these roles in a group are neighbours there."""
    return (one == 2 and other == 1) or (one == 1) or (one == 0 and other < 2)


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``counted`` (word, n; written, one row per word).

    Words are near if one letter inserted, deleted or replaced makes them equal. The form is the near word of largest n,
    the smallest in code-point order on ties, if its n is at least ``ratio`` times as large.
    Forms grow by that factor, so a chain of forms is short and has no ring; its end is the root.
    """
    bounded_batches(counted.sparkSession)
    met = _scan(_rotations(counted), ratio)
    # n as it is, words backwards: the largest pair is the largest n, then the smallest word
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form"))).alias("b")
    merged = met.groupBy(F.col("word").alias("_word")).agg(F.sum("near").alias("n_near"), best)
    found = settle(
        counted.join(merged, F.col("word") == F.col("_word"), "left").select(
            "word", F.col("b.form").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("b.m")).alias("form_n")
        ), "variants",
    )
    roots = settle(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = settle(join_lookup(roots, ahead, ["root"]).select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_went")), "roots")
        roots = moved.drop("_went")
        if moved.where("_went").isEmpty():
            break
    ends = roots.select(F.col("word").alias("_word"), "root")
    return found.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return variants(settle(words(table(spark, sf_dir, "documents")), "words"))


# Another way to the same rows: checksums by a table of bytes, neighbours by wildcard and deletion joins.
ORACLE = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i : list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS m, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY 1, 2),
summed AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i : CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
  lambda c, b : xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, tab),
words AS MATERIALIZED (SELECT CASE WHEN h % {SLIP} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(m) AS BIGINT) AS n FROM summed GROUP BY 1
  HAVING length(word) >= {MIN_LENGTH} AND sum(m) >= {MIN_COUNT}),
wild AS (SELECT word, n, word[1:i] || '*' || word[i + 2:] AS k FROM words, range(1000) r(i) WHERE i < length(word)),
less AS (SELECT DISTINCT word, n, word[1:i] || word[i + 2:] AS k FROM words, range(1000) r(i) WHERE i < length(word)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.k = b.word UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.k = b.word),
forms AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS o, max(m) AS m FROM near GROUP BY 1),
found AS (SELECT w.word, CASE WHEN m >= {RATIO} * n THEN o END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM words w LEFT JOIN forms USING (word)),
chain AS (SELECT word, word AS root, 0 AS steps FROM found UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)"""
