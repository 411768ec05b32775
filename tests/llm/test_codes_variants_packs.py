"""Vector codes, spelling variants and shortest-pack-first packing against brute force, with awkward rows."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm import byte_tokens, shortest_pack, spelling, value_dictionaries

VECTORS = "vec_id long, embedding array<double>, label int, code string, entry int"
DOCS = "doc_id long, text string, row long, ids string, word string, n int"


def written(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


# --- vector codes ---------------------------------------------------------------------


def codes_by_hand(rows, entries=256, rounds=4):
    kept = []
    for r in rows:
        v = r[1]
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((r[0], [math.floor(1024 * x) for x in v], r[2]))
    width = max((len(v) for _, v, _ in kept), default=0)
    kept = [(i, v + [0] * (width - len(v)), lb) for i, v, lb in kept]
    edges = [p * width // 4 for p in range(5)]
    part = lambda v, p: v[edges[p]:edges[p + 1]]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min((far(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            held = collections.defaultdict(list)
            for _, v, _ in kept:
                held[best(v, p)[1]].append(part(v, p))
            for k, members in held.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v, lb in kept:
        found = [best(v, p) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lb))
    return out, books


def vectors(n, width=10, scale=1.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, (scale * rng.normal(size=width)).tolist(), int(i % 4), "x", 1) for i in range(n)]
    rows[3] = (3, None, 1, None, None)
    rows[4] = (4, [float("nan")] + [0.5] * (width - 1), 1, None, None)
    rows[5] = (5, [None] + [0.5] * (width - 1), 1, None, None)
    rows[6] = (6, [float("inf")] * width, None, None, None)
    rows[7] = (7, [0.25] * (width - 3), None, None, None)
    rows[8] = (8, [], None, None, None)
    rows[9] = (9, [0.0] * width, None, None, None)
    return rows + [rows[12], rows[12], (None, [-0.001] * width, 2, None, None), (13, [1.5] * width, 2, None, None)]


@pytest.mark.parametrize("n, width, scale", [(700, 10, 1.0), (40, 8, 0.01), (30, 3, 1e6), (30, 8, 1e12), (30, 1, 1.0)])
def test_vector_codes_follow_the_rounds(spark, tmp_path, monkeypatch, n, width, scale):
    monkeypatch.setattr(value_dictionaries, "BLOCK_ROWS", 64)
    monkeypatch.setattr(value_dictionaries, "CHUNK_ROWS", 50)
    rows = vectors(n, width, scale)
    coded, books = value_dictionaries.compress(written(spark, tmp_path, rows, VECTORS))
    want, want_books = codes_by_hand(rows)
    assert books == want_books
    text = ",".join(str(x) for p in want_books for e in p for x in e)
    assert value_dictionaries.digest(books) == hashlib.sha256(text.encode()).hexdigest()
    total = collections.Counter()
    for _, _, error, label in want:
        total[label] += error
    fits = lambda x: x if x < 2**63 else None
    by_id = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted([tuple(r) for r in coded.select("vec_id", "code", "error", "label_error").collect()], key=by_id)
    assert got == sorted([(i, c, fits(e), fits(total[lb])) for i, c, e, lb in want], key=by_id)


def test_vector_codes_of_nothing_and_of_great_numbers(spark, tmp_path):
    coded, books = value_dictionaries.compress(written(spark, tmp_path, [], VECTORS))
    assert coded.count() == 0 and books == [[], [], [], []]
    rows = [(1, [1e300, 2.0, 3.0, 4.0], 1, "", 0), (2, [-1e300, 2.0, 3.0, 4.5], 1, "", 0), (3, [1e306, 0.0, 0.0, 0.0], 1, "", 0)]
    coded, books = value_dictionaries.compress(written(spark, tmp_path, rows, VECTORS))
    assert [r["code"] for r in coded.orderBy("vec_id").collect()] == ["00000000", "01000001"]
    assert [r["error"] for r in coded.collect()] == [0, 0] and books[0][0] == [int(1e300) * 1024]


def test_decoded_vectors(spark, tmp_path):
    rows = vectors(60, 8)
    coded, books = value_dictionaries.compress(written(spark, tmp_path, rows, VECTORS))
    got = value_dictionaries.decoded(coded, books).join(coded.select("vec_id", "code"), "vec_id").where("vec_id > 13").collect()
    assert got
    for r in got:
        ints = [x for p in range(4) for x in books[p][int(r["code"][2 * p:2 * p + 2], 16)]]
        assert r["approximation"] == [x / 1024 for x in ints]


# --- spelling variants ------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        around = [(-m, o) for o, m in counts.items() if near(w, o)]
        m, o = min(around, default=(0, None))
        out[w] = (o, n, len(around), -m) if o is not None and -m >= ratio * n else (None, n, len(around), None)
    rows = []
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


def test_variants_meet_every_neighbour(spark, monkeypatch):
    rng = np.random.default_rng(5)
    counts = {}
    for _ in range(600):
        w = "".join(rng.choice(list("abé÷"), rng.integers(1, 7)))
        counts[w] = int(10 ** rng.integers(0, 5) * rng.integers(1, 10))
    rows = settle(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5))
    assert sorted(map(tuple, spelling.variants(rows).collect())) == variants_by_hand(counts)
    monkeypatch.setattr(spelling, "TEXT_KEY", 3)  # text keys and digests side by side
    assert sorted(map(tuple, spelling.variants(rows).collect())) == variants_by_hand(counts)


def test_variants_of_long_words(spark):
    base = "ab" * 128
    words = {base: 500, base + "b": 5, "a" + base: 7, base[:100] + "z" + base[101:]: 20, base[:-1]: 5000, base[:-2]: 3, "q" * 5000: 9, "q" * 5001: 90}
    rows = settle(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(map(tuple, spelling.variants(rows).collect())) == variants_by_hand(words)


def test_words_count_whole_texts_and_slips(spark, tmp_path):
    text = "ÄPFELchen äpfelchen Äpfelchen straße-strasse Wunderbar wunderbar wunderbär x" + " langeswort" * 40
    rows = [(i, text, 1, "", "w", 3) for i in range(60)] + [(None, text, 1, "", "w", 3), (70, None, 1, "", "", 0), (71, "", 1, "", "", 0), (72, "a" * 30000 + " " + "a" * 30000, 1, "", "", 0)]
    rows += [rows[0], rows[0]]
    want = collections.Counter()
    for i, t, *_ in rows:
        run = ""
        for c in (t or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
            run = ""
    got = dict(map(tuple, spelling.words(written(spark, tmp_path, rows, DOCS)).collect()))
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert any(len(w) < 10 and "langeswort" != w and near(w, "langeswort") for w in got)
    empty = written(spark, tmp_path, [], DOCS)
    assert spelling.variants(settle(spelling.words(empty))).count() == 0


# --- packing ----------------------------------------------------------------------------


def test_ids_are_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    path = shortest_pack.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    odd = ["a", " ", "  ", "\n", "\t", "é", " ", "!", "'s", "9", "<|endoftext|>", " ", "\x1c", "\r", "漢", "the", "\u0085", "​"]
    even = ["a", "the", " of", " ", "\n", "ü", "!", "'ll", "7", ".", ","]
    texts = ["".join(rng.choice(pool, rng.integers(0, 25))) for pool in (odd, even) for _ in range(3000)]
    monkeypatch.setattr(byte_tokens, "SECTION", 9)
    monkeypatch.setattr(byte_tokens, "MEMORY_WORDS", 100)
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        ids, counts = byte_tokens.encode(pa.array(part), path)
        cuts = np.split(ids, np.cumsum(counts)[:-1])
        assert [c.tolist() for c in cuts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_every_sequence(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(2 + seed, 1, 5000).astype(int) + 1, 256)
    counts = dict(collections.Counter(lengths.tolist()))
    made = shortest_pack.plan(counts, 256)
    used = collections.defaultdict(list)
    for length, rank, end, sequence, offset, line, step in made.slots:
        for k in range(end - rank):
            if sequence >= 0:
                used[sequence + k].append((offset, length))
            else:
                used["line"].append((line + k * step, length))
    for start, end, sequence, offset, size in made.rooms:
        used["room"].append((start, end - start))
        for k in range((end - start) // size):
            used[sequence + k].append((offset, size))
    for places in used.values():
        places.sort()
        assert [p[0] for p in places] == np.cumsum([0] + [p[1] for p in places])[:-1].tolist()
    line, room = (sum(p[1] for p in used.pop(k, [])) for k in ("line", "room"))
    assert line == room and sorted(used) == list(range(made.sequences))
    fills = [sum(p[1] for p in places) for places in used.values()]
    assert all(f == 256 or f & (f - 1) == 0 for f in fills) and sum(f != 256 for f in fills) <= 8
    for length, n in counts.items():
        ranks = sorted((s[1], s[2]) for s in made.slots if s[0] == length)
        assert [r[0] for r in ranks] == [0] + [r[1] for r in ranks][:-1] and ranks[-1][1] == n


@pytest.mark.parametrize("capacity", [16, 2048])
def test_documents_are_packed_whole(spark, tmp_path, capacity):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    pool = ["the", "pricing", "of", "ünter", "straße", "x", "1234", "."]
    rows = [(i, " ".join(rng.choice(pool, rng.integers(0, 60))), 1, "", "", 2) for i in range(300)]
    rows += [(400, None, 1, "", "", 0), (401, "", 1, "", "", 0), (None, "no  id", 1, "", "", 0), (402, "word " * 9000, 1, "", "", 0), (5, rows[5][1], 1, "", "", 0)]
    docs = written(spark, tmp_path, rows, DOCS)
    got = shortest_pack.pack(settle(shortest_pack.pieces(docs, capacity)), capacity).toPandas()
    tokenizer = Tokenizer.from_file(shortest_pack.tokenizer_path())
    ids = {r[0]: np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in rows}
    for doc_id, part in got.groupby("doc_id", dropna=False):
        mine = ids[None if doc_id != doc_id else doc_id]
        assert (part["doc_tokens"] == len(mine)).all()
        assert all(zlib.crc32(mine[s:s + n].tobytes()) == c for s, n, c in zip(part["start"], part["length"], part["ids_crc32"]))
        seen = collections.Counter(k for s, n in zip(part["start"], part["length"]) for k in range(s, s + n))
        assert set(seen.values()) == {2 if doc_id == 5 else 1} and len(seen) == len(mine)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == np.cumsum([0, *part["length"]])[:-1].tolist()
        fill = int(part["length"].sum())
        assert fill == capacity or (fill < capacity and fill & (fill - 1) == 0)
    assert shortest_pack.pack(settle(shortest_pack.pieces(written(spark, tmp_path, [], DOCS)))).count() == 0
