"""Text operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm import common, graph, mixing, order_minhash, packing, permutation, pitman_yor, substrings, tokens, topk, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank string"
WORDS = [f"w{i}" for i in range(400)]


def words(rng, n):
    return [WORDS[i] for i in rng.integers(0, len(WORDS), n)]


def corpus():
    """Copies, near copies, nulls, blanks, repeated rows, null sources and ids, a long text, columns with clashing names."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words(rng, 30 + 7 * i)), "en" if i % 2 else "de", f"s{i % 4}", 1, 7, "x"))
    for i in range(40, 50):  # near copies of document 20
        t = rows[20][1].split()
        t[rng.integers(0, len(t))] = "changed"
        rows.append((i, " ".join(t), "en", "s0", 1, 7, None))
    rows += [(i, rows[5][1], "en", "s1", 1, 7, None) for i in range(50, 56)]
    rows += [(60, None, None, None, None, None, None), (61, "", "en", "s1", 0, 0, ""), (62, " \n\t ", "en", "s2", 0, 0, ""), (63, "one", "fr", None, 3, 3, "")]
    rows += [(64, "a b c", "fr", "s3", 3, 3, "")] * 3
    rows.append((65, " ".join(words(rng, 20000)), "en", "s3", 1, 1, "long"))
    rows.append((None, "no id here at all", "en", "s3", 1, 1, ""))
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus(), DOCS).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_ranks_of_a_hot_key_are_exact(spark):
    rows = settle(spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), "id"))
    got = common.rank_within(rows, ["k"], ["id"]).groupBy("k").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count("*")).collect()
    assert all(r[1] == 0 and r[2] == r[4] - 1 and r[3] == r[4] for r in got)


def test_mixing_meets_targets(docs, nothing):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(corpus())
    assert sorted(got["size"]) == sorted(word_count(r[1]) for r in corpus())
    assert (got["taken"] <= 3 * got["size"]).all()
    sizes = collections.Counter()
    for r in corpus():
        sizes[r[3]] += word_count(r[1])
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * sizes[s]}
        if not full:
            break
        target |= {s: 3 * sizes[s] for s in full}
        open_ -= full
        left -= sum(target[s] for s in full)
    target |= {s: weight[s] * level for s in open_}
    for s in order:
        mine = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert mine["target"].iloc[0] == pytest.approx(target[s])
        assert abs(mine["taken"].sum() - target[s]) <= max(mine["size"][mine["size"] > 0].min(), 0.02 * target[s], mine["size"].max() / 2 if mine["size"].max() > target[s] else 0)
    again = mixing.mix(docs).toPandas()
    assert collections.Counter(map(tuple, got[["doc_id", "taken"]].fillna(-1).to_numpy().tolist())) == collections.Counter(
        map(tuple, again[["doc_id", "taken"]].fillna(-1).to_numpy().tolist()))
    assert mixing.mix(nothing).count() == 0


def test_mixing_rates_are_the_entropy_balance(docs):
    """Every rate is min(cap, exp(m size)) for one m per source."""
    got = mixing.mix(docs).where("size > 0").toPandas()
    for _, mine in got.groupby("source"):
        low = mine[mine["rate"] < 3 - 1e-9]
        if len(low) > 1:
            m = np.log(low["rate"]) / low["size"]
            assert m.max() - m.min() < 1e-6


def test_packing_fills_sequences(docs, nothing):
    from tokenizers import Tokenizer

    got = packing.pack(settle(packing.pieces(docs, with_ids=True))).toPandas()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for r in corpus():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for i, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start:start + 2048]
            want[(-1 if r[0] is None else r[0], i, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert collections.Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int).to_numpy().tolist())) == want
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(got["ids"], got["ids_crc32"]))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 2048) + 1
    assert packing.pack(settle(packing.pieces(nothing))).count() == 0


def test_packing_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 65, rng.integers(1, 300)).tolist()
        used = collections.defaultdict(int)
        for length, first, end, sequence, offset in packing.plan(collections.Counter(lengths), 64):
            for r in range(end - first):
                assert used[sequence + r] == offset
                used[sequence + r] += length
        assert sum(used.values()) == sum(lengths) and max(used.values()) <= 64
        rooms = []
        for length in sorted(lengths, reverse=True):
            best = min((i for i, r in enumerate(rooms) if r >= length), key=lambda i: rooms[i], default=None)
            rooms.append(64 - length) if best is None else rooms.__setitem__(best, rooms[best] - length)
        assert len(used) <= len(rooms)


def test_tokens_word_by_word_equal_whole_texts():
    path = packing.tokenizer_path()
    tokenizer = packing._tokenizer(path)
    texts = ["a <|ENDOFTEXT|> b", "x<|endoftext|>. Y", "\u00c9COLE E\u0301. \u00df\u2014 z.", "don't. STOP'S", "1.,! 2a.", "", "\u2014. ..", "\x1c a\xa0b.", "\u03a3\u03b1\u03a3 \u0130.!"]
    got = packing.encoded([t.encode() for t in texts], path, tokenizer)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


PAGES = [
    (1, "http://a.example.net/x", "<p>" + "long " * 400), (2, None, "<p>" + "long " * 400), (3, "http://b\r\nX: 1", "short"), (4, "u", "short"),
    (5, "u", None), (6, "u", ""), (7, "u", "<p>" + "long " * 400), (7, "u", "<p>" + "long " * 400), (None, "u", "<p>" + "long " * 400),
    (8, "u", "é" * 700 + "\r\n\r\nWARC/1.1"), (9, "u", "z" * 3_000_000),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("frame", F.lit(1))
    bundles = settle(warc.write_bundles(pages, frame_bytes=4000))
    got = warc.read_bundles(bundles, with_payload=True).collect()
    assert len(got) == len(PAGES)
    html = {}
    for p in PAGES:
        html[p[0]] = (p[2] or "").encode()
    top = {}
    for i, _, t in PAGES:
        if i is not None:
            top[t] = max(top.get(t, i), i)
    for r in got:
        body = html[r["page_id"]]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha1(body).hexdigest()
        revisit = len(body) >= 1000 and top[body.decode()] != r["page_id"]
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (top[body.decode()] if revisit else None)
        assert revisit or bytes(r["payload"]) == body
    some = warc.fetch(bundles, spark.createDataFrame([(3,), (8,), (77,)], "page_id long")).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in some) == [(3, b"short"), (8, html[8])]


def test_warc_files_can_be_read_by_frames(spark, tmp_path):
    import zstandard

    bundles = settle(warc.write_bundles(spark.createDataFrame(PAGES, "page_id long, url string, html string"), frame_bytes=4000))
    paths = [r["path"] for r in warc.save_files(bundles, f"file://{tmp_path}").collect()]
    records = 0
    for path in paths:
        data = open(path, "rb").read()
        for start, packed, plain in warc.frame_places(data):
            text = zstandard.ZstdDecompressor().decompress(data[start:start + packed])
            assert len(text) == plain
            records += text.count(b"WARC-Record-ID: ")
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n")  # the footer is a frame that plain readers skip
    assert records == len(PAGES)
    none = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_bundles(settle(none)).count() == 0


URLS = [
    (1, "http://WWW.Example.org/en/12?x"), (2, "http://example.org/es/a"), (3, "http://notexample.org/en/1"), (4, "https://a.com/fr/2#t"),
    (5, "https://a.com/de/3"), (6, "https://a.com"), (7, None), (8, "no scheme"), (9, "x://h?q/://y"), (10, ""), (10, ""), (11, "http://com/de/"),
] + [(100 + i, f"http://b.com/de/{i}") for i in range(30)] + [(200 + i, f"http://b.com/zz/{i}.html") for i in range(30)] + [(300 + i, "http://deep.net/" + "/".join("abcdefghijklm")) for i in range(2)]


def expected_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(str.maketrans(common.UPPER, common.LOWER))
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None)))


def test_url_rules_and_tree(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("n", F.lit(1))
    got = urls.judge(pages).collect()
    assert len(got) == len(URLS)
    by_id = dict(URLS)
    for r in got:
        host, path, rule, verdict = expected_rule(by_id[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_deep_paths_are_told_apart(spark):
    deep = "/a" * 8
    paths = [(i, f"{deep}/{'good' if i % 2 else 'bad'}/x", i % 2 == 0) for i in range(40)]
    pages = spark.createDataFrame([(i, f"http://deep.test{p}") for i, p, _ in paths], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, _, bad in paths], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules=(), labels=labels).collect()}
    assert got == {i: "block" if bad else "allow" for i, _, bad in paths}


def test_url_tree_rejects_impure_templates(spark):
    pages = spark.createDataFrame(
        [(i, f"http://h.net/{'bad' if i % 2 else 'good'}/{i}.html") for i in range(200)] + [(900 + i, f"http://h.net/user{chr(97 + i % 26)}{'q' * (i // 26)}/p") for i in range(60)],
        "page_id long, url string")
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(0, 150)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urls.judge(pages, (), labels).collect()}
    assert {got[i]["verdict"] for i in range(1, 200, 2)} == {"block"} and {got[i]["verdict"] for i in range(0, 200, 2)} == {"allow"}
    assert got[1]["template"] == "/bad/#.html"[:-5] + ".html" and len({got[900 + i]["template"] for i in range(60)}) == 1


VECTORS = "vec_id long, embedding array<float>, v string"


def vectors(spark, n=900, dims=12, copies=100):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[n - copies:] = x[50]
    rows = [(i, [float(c) for c in r], "x") for i, r in enumerate(x)]
    rows += [(10_000, None, ""), (10_050, [], ""), (10_100, [float("nan")] * dims, ""), (10_150, [None] * dims, ""), (10_200, [0.0] * dims, ""), (None, rows[0][1], "")]
    rows.append(rows[100])
    return rows, spark.createDataFrame(rows, VECTORS)


def test_uniform_threshold_is_exact(spark):
    rows, table = vectors(spark)
    real = {r[0]: np.floor(1024 * np.array(r[1], float)).astype(np.int64) for r in rows if r[0] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1])}
    got = collections.defaultdict(list)
    for r in topk.top_k(table, every=100, top=10).orderBy("rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in real if i % 100 == 0}
    for q, found in got.items():
        want = sorted(((int(real[q] @ x), -i) for i, x in real.items() if i != q), reverse=True)[:10]
        assert found == [(-i, s) for s, i in want]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (100, [3.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(few).collect())) == [(0, 1, 100, 3 * 1024 * 1024), (100, 1, 0, 3 * 1024 * 1024)]
    assert topk.top_k(few.where("vec_id < 0")).count() == 0


def test_products_of_large_numbers_stay_exact():
    q = np.floor(np.array([[2.0**29, 1.0]]))
    x = np.floor(np.array([[2.0**29, 1.0], [2.0**29, 2.0]]))
    assert topk.products(q, x).tolist() == [[2**58 + 1, 2**58 + 2]]


def test_permutation_index_finds_nearest(spark):
    rows, table = vectors(spark)
    real = {r[0]: np.array(r[1], float) for r in rows if r[0] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])}
    got = collections.defaultdict(list)
    for r in permutation.nearest(table, every=50).orderBy("rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in real if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        cos = {i: float(real[q] @ x / (np.linalg.norm(real[q]) * np.linalg.norm(x))) for i, x in real.items() if i != q}
        assert all(abs(cos[i] - s) < 1e-12 for i, s in found) and len(found) == 5
        hits += len({i for i, _ in found} & set(sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]))
    assert hits >= 0.9 * 5 * len(got)
    assert permutation.nearest(table.where("vec_id < 0")).count() == 0


def test_permutation_index_reaches_recall_on_a_full_block(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 32))
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = permutation.nearest(table, every=300).toPandas()
    hits = 0
    for q, mine in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(mine["vec_id"]))
    assert hits >= 0.9 * len(got)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def test_banded_alignment_equals_the_full_table(monkeypatch):
    rng = np.random.default_rng(0)
    for way in ("bits", "table", "lazy"):
        if way != "bits":
            monkeypatch.setattr(tokens, "BIT_WORDS", 0)
        if way == "lazy":
            monkeypatch.setattr(tokens, "_runs", None)
            monkeypatch.setattr(tokens, "_banded", _without_table(tokens._banded))
        for t in range(400):
            a = rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64)
            b = np.delete(a, rng.integers(0, len(a), 2)) if len(a) and t % 2 else rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64)
            limit = int(rng.integers(0, 25))
            assert tokens.edit_distance(a, b, limit) == min(brute_distance(a, b), limit + 1)


def _without_table(banded):
    """The same alignment with runs followed word by word, as for very wide bands."""
    import types

    code = banded.__code__.replace(co_consts=tuple(0 if c == 1 << 23 else c for c in banded.__code__.co_consts))
    return types.FunctionType(code, banded.__globals__, "lazy")


def test_word_bits_rule_out_no_similar_text():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 60).astype(np.uint64)
    texts = [words[rng.integers(0, 60, n)] for n in (0, 1, 2, 30, 90, 90, 400)]
    for t in texts[2:]:
        for share in (0.1, 0.2, 0.25):
            changed = t.copy()
            changed[rng.choice(len(t), int(share * len(t)), False)] = words[0]
            texts += [changed, np.delete(t, rng.choice(len(t), int(share * len(t)), False))]
    counts = np.array([len(t) for t in texts])
    bits = order_minhash.word_bits(np.concatenate(texts), counts)
    ruled_out = 0
    for i in range(len(texts)):
        others = np.delete(np.arange(len(texts)), i)
        kept = order_minhash.may_match(bits, counts, i, others, 0.8).tolist()
        for j in others.tolist():
            limit = int(np.floor(0.2 * max(counts[i], counts[j]) + 1e-9))
            ruled_out += j not in kept
            assert j in kept or brute_distance(texts[i].tolist(), texts[j].tolist()) > limit
    assert ruled_out > len(texts) ** 2 / 2


def test_near_copies(docs, nothing):
    got = {}
    for r in order_minhash.near_copies(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["class_id"], r["class_size"]))
    assert sum(len(v) for v in got.values()) == len(corpus())
    assert all(got[i] == [(20, 11)] for i in [20, *range(40, 50)])
    assert all(got[i] == [(5, 7)] for i in [5, *range(50, 56)])
    assert all(got[i] == [(60, 3)] for i in (60, 61, 62))
    assert got[64] == [(64, 3)] * 3 and got[63] == [(63, 1)] and got[65] == [(65, 1)] and got[None] == [(None, 1)]
    assert all(got[i] == [(i, 1)] for i in range(40) if i not in (5, 20))
    assert order_minhash.near_copies(nothing).count() == 0


def test_near_copies_meet_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(25):
        base = words(rng, int(rng.integers(60, 150)))
        for _ in range(int(rng.integers(1, 8))):
            t = list(base)
            for _ in range(int(rng.integers(0, 3))):
                t[rng.integers(0, len(t))] = WORDS[rng.integers(0, 400)]
            texts.append(t)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_copies(spark.read.parquet(path)).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if abs(len(texts[i]) - len(texts[j])) < 40 and brute_distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}


def test_near_copies_of_hubs_and_boilerplate_meet_brute_force(spark, tmp_path, monkeypatch):
    """Copies that are like an original but not like each other, and texts that share most of their words but stay apart."""
    monkeypatch.setattr(order_minhash, "TILE", 16)
    rng = np.random.default_rng(21)
    new = iter(f"n{i}" for i in range(1_000_000))

    def changed(text, share):
        t = list(text)
        for i in rng.choice(len(t), round(share * len(t)), replace=False):
            t[i] = next(new)
        return t

    hub = [next(new) for _ in range(150)]
    notice = [next(new) for _ in range(90)]
    texts = [changed(hub, 0.12) for _ in range(60)] + [hub]
    for _ in range(40):
        own = notice + [next(new) for _ in range(40)]
        texts += [own, changed(own, 0.17)] if rng.random() < 0.5 else [own]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_copies(spark.read.parquet(path)).collect()}
    ids = {w: i for i, w in enumerate(sorted(set(sum(texts, []))))}
    coded = [np.array([ids[w] for w in t], np.uint64) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            limit = int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)
            if tokens.edit_distance(coded[i], coded[j], limit) <= limit:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert len(set(root[:61])) == 1
    assert got == dict(enumerate(root))


def test_shuffled_text_is_no_near_copy(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = words(rng, 200)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[100:] + a[:100]))], "doc_id long, text string").write.parquet(path)
    assert {r["class_id"] for r in order_minhash.near_copies(spark.read.parquet(path)).collect()} == {1, 2}


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{100 + i: 100 for i in range(1, 50)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chain_takes_the_best_ordered_segments():
    rng = np.random.default_rng(4)
    for _ in range(200):
        segments = sorted({(int(x), int(n), int(y)) for x, n, y in zip(rng.integers(0, 60, 7), rng.integers(6, 12, 7), rng.integers(0, 60, 7))})
        best = {}
        for i, (x, n, y) in enumerate(segments):
            best[i] = float(n)
            for j in range(len(segments)):
                a, m, b = segments[j]
                if j in best and a + m - 5 <= x and b + m - 5 <= y:
                    gap = 0.2 * (x - (a + m - 5) + y - (b + m - 5))
                    best[i] = max(best[i], n + best[j] - gap)
        path = substrings.chain(segments)[0]
        score = 0.0
        for p, i in enumerate(path):
            x, n, y = segments[i]
            score += n
            if p:
                a, m, b = segments[path[p - 1]]
                score -= 0.2 * (x - (a + m - 5) + y - (b + m - 5))
        assert score == pytest.approx(max(best.values()))


def test_repeated_passages(spark, tmp_path, nothing):
    rng = np.random.default_rng(5)
    shared = words(rng, 80)
    fuzzy = list(shared)
    fuzzy[30], fuzzy[50] = "x1", "x2"
    del fuzzy[60]
    rows = [(i, " ".join(words(rng, 60 + i) + shared + words(rng, 40))) for i in range(6)]
    rows += [(10, " ".join(words(rng, 90) + fuzzy + words(rng, 20))), (11, " ".join(words(rng, 30) + shared[:30] + words(rng, 30))), (12, None), (13, ""), (14, "short"), (15, " ".join(words(rng, 500)))]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r["doc_id"]: r for r in substrings.passages(docs).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 10}
    for i in range(1, 6):
        assert got[i]["source_id"] == 0 and got[i]["start"] <= 60 + i and got[i]["end"] >= 140 + i and got[i]["end"] - got[i]["start"] < 86
        assert got[i]["identity"] > 0.95
    assert got[10]["start"] <= 90 and got[10]["end"] >= 169 and got[10]["identity"] < 1
    kept = {r["doc_id"]: r["text"] for r in substrings.stage(spark, docs, "").collect()}
    assert set(kept) == {r[0] for r in rows}
    assert len(kept[0].split()) == 180 and all(98 - 6 <= len(kept[i].split()) - i <= 100 for i in range(1, 6))
    assert kept[11] == rows[7][1] and kept[15] == rows[11][1] and kept[12] is None
    assert substrings.passages(nothing).count() == 0


def test_two_passages_at_any_gap_are_found(spark, tmp_path):
    """Pairs of documents that share two passages with other words between: one piece while it is similar enough, else both."""
    rng = np.random.default_rng(12)
    other = iter(f"u{i}" for i in range(1_000_000))
    rows, shared = [], {}
    for gap in range(5, 160, 6):
        one, two = ([next(other) for _ in range(n)] for n in (60, 60))
        for side in (0, 1):
            filler = [[next(other) for _ in range(n)] for n in (30, gap, 30)]
            rows.append((2 * gap + side, " ".join(filler[0] + one + filler[1] + two + filler[2])))
        shared[2 * gap + 1] = (one + filler[1] + two, gap)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {}
    for r in substrings.passages(spark.read.parquet(path)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["source_id"], r["source_start"], r["source_end"]))
    texts = {i: t.split() for i, t in rows}
    for i, (_, gap) in shared.items():
        joined = 1 - brute_distance(texts[i][30:150 + gap], texts[i - 1][30:150 + gap]) / (120 + gap)
        want = [(30, 150 + gap)] if joined >= substrings.IDENTITY else [(30, 90), (90 + gap, 150 + gap)]
        assert sorted(got[i]) == [(a, b, i - 1, a, b) for a, b in want], gap
    assert set(got) == set(shared)


@pytest.mark.parametrize("every", [5, 6, 8, 10, 20])
def test_passages_with_every_nth_word_changed_are_found(spark, tmp_path, every):
    """Recall of planted 70-word passages down to the promised identity, among unlike texts."""
    rng = np.random.default_rng(every)
    other = iter(f"u{i}" for i in range(1_000_000))
    rows = []
    for i in range(60):
        shared = words(rng, 70)
        changed = [next(other) if (j + i) % every == every - 1 else w for j, w in enumerate(shared)]
        for side, passage in enumerate((shared, changed)):
            rows.append((2 * i + side, " ".join(words(rng, 40) + passage + words(rng, 40))))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = substrings.passages(spark.read.parquet(path)).collect()
    assert all(r["source_id"] == r["doc_id"] - 1 and r["start"] >= 34 and r["end"] <= 116 and r["identity"] >= 0.8 - 1e-9 for r in got)
    assert len({r["doc_id"] for r in got}) >= 0.9 * 60


def test_pieces_of_a_chain_meet_brute_force():
    rng = np.random.default_rng(13)
    for _ in range(60):
        a, b, xs, ns, ys = [], [], [], [], []
        for _ in range(int(rng.integers(1, 6))):
            for t in (a, b):
                t += rng.integers(1000, 1 << 40, int(rng.integers(0, 25))).tolist()
            n = int(rng.integers(6, 40))
            xs.append(len(a)), ns.append(n), ys.append(len(b))
            run = rng.integers(1000, 1 << 40, n).tolist()
            a, b = a + run, b + run
        got = substrings.align(np.array(a, np.uint64), np.array(b, np.uint64), xs, ns, ys)
        similar = []
        for i in range(len(xs)):
            for j in range(i, len(xs)):
                p, q = a[xs[i]:xs[j] + ns[j]], b[ys[i]:ys[j] + ns[j]]
                if brute_distance(p, q) <= 0.2 * max(len(p), len(q)):
                    similar.append((i, j))
        want = [(i, j) for i, j in similar if not any((p, q) != (i, j) and p <= i and j <= q for p, q in similar)]
        assert [g[:4] for g in got] == [(xs[i], xs[j] + ns[j], ys[i], ys[j] + ns[j]) for i, j in want]


def test_cut_words_keeps_the_rest():
    text = "  a b\tc\nd  e".encode()
    assert substrings.cut_words(text, [(1, 3)]) == b"  a d  e"
    assert substrings.cut_words(text, [(0, 5)]) == b"  " and substrings.cut_words(text, [(3, 9)]) == b"  a b\tc\n"
    assert substrings.cut_words(text, [(0, 2), (1, 3)]) == b"  d  e"


def toxic_rows(n=600):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        t = words(rng, 60)
        if toxic:
            for _ in range(4):
                t[rng.integers(0, 60)] = ["awful", "nasty", "vileword"][rng.integers(0, 3)]
        rows.append((i, " ".join(t), ["en", "de"][i % 2], "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None, None, "s", 0), (9001, "", "en", "s", 0), (9002, " ".join(words(rng, 70000)) + " nasty awful vileword", "en", "s", 0), (None, "nasty", "en", "s", 0)]
    labels += [(9000, 1, None), (None, 1, 1), (77777, 1, 1), (3, 1, 0)]
    return rows, labels


def test_toxicity_is_learned(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, marks).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    want = {r[0]: r[2] for r in labels[:600]}
    held = got[got["held_out"] & got["doc_id"].isin(list(want))]
    assert all(zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in held["doc_id"])
    assert (held["predicted"] == held["doc_id"].map(want)).mean() > 0.95
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    assert got.loc[got["doc_id"] == 9002, "predicted"].item() == 1
    none = toxicity.classify(docs, marks.where("toxic = 0")).toPandas()
    assert (none["predicted"] == 0).all()
    assert toxicity.classify(docs.where("doc_id < 0"), marks).count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Every labelled row outside the held-out slot is trained on or calibrates, in several shards."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    rng = np.random.default_rng(2)
    n = 8000
    rows = [(i, " ".join(["vileword"] * (i % 2) + list(words(rng, 8))), "en") for i in range(n)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    used, settled = {}, toxicity.settle
    monkeypatch.setattr(toxicity, "settle", lambda df, label: used.setdefault(label, settled(df, label)))
    model, limits = toxicity.fit(docs, marks)
    usable = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(n))
    assert usable > 5000 and used["labelled-words"].count() == usable
    assert 0.15 < used["calibration"].count() / usable < 0.25
    scores = model.scores([toxicity.Words()(r[1]) for r in rows[:400]])
    assert ((scores >= limits["en"]) == np.arange(400) % 2).mean() > 0.98


def test_shards_average_to_one_model(spark):
    start = toxicity.new_model()
    trainers = [toxicity._Trainer(start) for _ in range(2)]
    read = toxicity.Words()
    for t, text in zip(trainers, ("only here both", "both there")):
        for _ in range(1 if text == "both there" else 3):
            t.step([read(text)], np.ones(1), np.ones(1))
    both = spark.createDataFrame([r for t in trainers for r in t.parts().to_pylist()], toxicity._PARTS_DDL)
    got = toxicity._averaged(start, both.coalesce(1).mapInArrow(toxicity._merge, toxicity._PARTS_DDL).collect())
    n = np.array([t.touches for t in trainers], float)
    want = sum(t.model.embed * k[:, None] for t, k in zip(trainers, n)) / np.maximum(n.sum(axis=0), 1)[:, None]
    some = n.sum(axis=0) > 0
    assert some.any() and np.allclose(got.embed[some], want[some], atol=1e-6) and (got.embed[~some] == start.embed[~some]).all()
    assert np.allclose(got.out, (3 * trainers[0].model.out + trainers[1].model.out) / 4, atol=1e-6)


def test_pooling_does_not_depend_on_batches():
    model = toxicity.new_model(3)
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 1000, n) << 32 | rng.integers(1, 1000, n) for n in (0, 1, 2, 500, toxicity.CHUNK + 7, 3)]
    whole = model.pooled(texts)
    for i, t in enumerate(texts):
        assert np.allclose(model.pooled([t])[0], whole[i], atol=1e-5)


def lm_counts(rows):
    split = {}
    for i, r in enumerate(rows):
        text = (r[1] or "").translate(str.maketrans(common.UPPER, common.LOWER))
        held = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2
        split[i] = (r[0], held, re.findall(r"[^\x20\x09-\x0D]+", text) + ["\n"])
    return split


@pytest.mark.parametrize("bucket_tokens", [1_500_000, 3000])
def test_language_model(spark, docs, nothing, monkeypatch, bucket_tokens):
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", bucket_tokens)
    got = pitman_yor.score_texts(docs).toPandas()
    split = lm_counts(corpus())
    c = collections.Counter(w for _, held, t in split.values() if not held for w in t)
    total = sum(c.values())
    want = collections.Counter()
    for i, held, t in split.values():
        want[(-1 if i is None else i, held, len(t), sum(c[w] > 0 for w in t), total, round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in t), 6))] += 1
    have = collections.Counter(
        (int(r.doc_id) if r.doc_id == r.doc_id else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples())
    assert have == want
    assert (got["score"] < 0).all()
    known = got[~got["held_out"] & (got["n_tokens"] > 20)]
    assert known["score"].sum() > known["base_score"].sum()
    if bucket_tokens > 3000:
        assert pitman_yor.score_texts(nothing).count() == 0


def test_language_model_is_a_distribution(spark, tmp_path):
    """Each pair of words in a text of its own: the probabilities after a context sum to 1, with one unknown word."""
    rng = np.random.default_rng(6)
    train = [(i, " ".join(f"v{int(x)}" for x in rng.zipf(1.5, 40) % 12)) for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    vocabulary = sorted({w for _, t in train for w in t.split()}) + ["unknownword"]
    held = [i for i in range(10_000, 40_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    asked = [(a, b) for a in ["v1", "v2", "unknownword"] for b in vocabulary]
    rows = train + [(held[n], f"{a} {b}") for n, (a, b) in enumerate(asked)] + [(held[len(asked) + n], a) for n, a in enumerate(["v1", "v2", "unknownword"])]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    score = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(spark.read.parquet(path)).collect()}
    # P(a b end) = P(a) P(b|a) P(end|b) and P(b end) = P(b) P(end|b), so the ratio of P(a b end) for two a is that of P(a) P(b|a)
    single = {a: 10 ** score[held[len(asked) + n]] for n, a in enumerate(["v1", "v2", "unknownword"])}
    whole = {(a, b): 10 ** score[held[n]] for n, (a, b) in enumerate(asked)}
    assert all(0 < p < 1 for p in [*single.values(), *whole.values()])
    # all texts of two words that begin with a weigh less than those that begin with a
    for a in ("v1", "v2", "unknownword"):
        assert sum(whole[a, b] for b in vocabulary) + single[a] < 1
    assert sum(whole[a, b] for a in ("v1", "v2", "unknownword") for b in vocabulary) + sum(single.values()) < 1


def test_gibbs_moves_keep_customers_and_reach_the_posterior():
    """Table counts of many equal dishes against the exact distribution by enumeration of partitions."""
    rng = np.random.default_rng(0)
    c, weight, d, n = 4, 0.7, 0.4, 4000
    sizes, begins = np.full(n, c, np.int64), np.arange(n)
    counts, w = np.full(n, c), np.full(n, weight)
    for _ in range(30):
        sizes, begins = pitman_yor.reseat(sizes, begins, counts, w, d, 2, rng)
        assert (np.add.reduceat(sizes, begins) == c).all() and (sizes > 0).all()
    tables = np.diff(np.append(begins, len(sizes)))
    # P(t) in proportion to weight^t S_d(c, t), with fixed weight of a new table
    stirling = {(1, 1): 1.0}
    for m in range(1, c):
        for t in range(1, m + 2):
            stirling[(m + 1, t)] = stirling.get((m, t - 1), 0.0) + (m - d * t) * stirling.get((m, t), 0.0)
    p = np.array([weight**t * stirling[(c, t)] for t in range(1, c + 1)])
    p /= p.sum()
    seen = np.bincount(tables, minlength=c + 1)[1:] / n
    assert np.abs(seen - p).max() < 0.03


@pytest.mark.parametrize("dishes", [1, 200])
def test_every_customer_of_a_frequent_dish_moves(dishes):
    """Frequent dishes that start with a table per customer have few tables after some sweeps."""
    rng = np.random.default_rng(3)
    counts = np.append(np.full(dishes, 400), [1, 1])
    sizes, begins = np.ones(counts.sum(), np.int64), np.cumsum(counts) - counts
    for _ in range(5):
        sizes, begins = pitman_yor.reseat(sizes, begins, counts, np.full(len(counts), 0.5), 0.3, 1, rng)
        assert (np.add.reduceat(sizes, begins) == counts).all() and (sizes > 0).all()
    tables = np.diff(np.append(begins, len(sizes)))
    assert tables[:-2].max() < 80 and (tables[-2:] == 1).all()


@pytest.mark.parametrize("dishes", [1, 200])
def test_frequent_dishes_reach_the_posterior(dishes):
    """Mean tables of dishes of 20 customers, moved one by one or many at once."""
    rng = np.random.default_rng(4)
    c, weight, d = 20, 0.5, 0.3
    sizes, begins, counts, seen = np.full(dishes, c), np.arange(dishes), np.full(dishes, c), []
    for sweep in range(40 if dishes > 1 else 4000):
        sizes, begins = pitman_yor.reseat(sizes, begins, counts, np.full(dishes, weight), d, 1, rng)
        seen += np.diff(np.append(begins, len(sizes))).tolist() if sweep >= 10 else []
    stirling = {(1, 1): 1.0}
    for m in range(1, c):
        for t in range(1, m + 2):
            stirling[(m + 1, t)] = stirling.get((m, t - 1), 0.0) + (m - d * t) * stirling.get((m, t), 0.0)
    p = np.array([weight**t * stirling[(c, t)] for t in range(1, c + 1)])
    assert np.mean(seen) == pytest.approx((np.arange(1, c + 1) * p).sum() / p.sum(), rel=0.05)


def test_packed_integers_round_trip():
    rng = np.random.default_rng(0)
    for a, delta in ((np.sort(rng.integers(0, 2**63, 100).astype(np.uint64)), True), (rng.normal(size=5), False), (np.zeros(0, np.int32), False), (np.zeros(0, np.uint64), True)):
        assert (pitman_yor._widen(pitman_yor._squeeze(a, delta), a.dtype, delta) == a).all()


def test_words_are_hashed_alike_and_not_remembered():
    import random

    import xxhash

    rnd = random.Random(5)
    texts = [b"", b" \t", b"\x00 \x00\x00", "ÉTÉ Été".encode(), b"\x1c\x85\xa0 x", b" ".join(b"Q" * n for n in range(50))]
    texts += [bytes(rnd.choice(b"abZ \n\t\x0b\x0c\r\x1c\x00\xff") for _ in range(rnd.randrange(90))) for _ in range(200)]
    tokens._held["another"] = {}
    words, counts = tokens.word_hashes(texts)
    split = [t.lower().split() for t in texts]
    assert counts.tolist() == [len(s) for s in split]
    assert words.tolist() == [xxhash.xxh64_intdigest(w) for s in split for w in s]
    # neither a dictionary of words stays in the worker nor what another operator left there
    assert not tokens._held
    assert [len(x) for x in tokens.word_hashes([])] == [0, 0]


def test_a_text_meets_its_bits_once_whatever_its_buckets(spark):
    rows = [(a, 10, s, s, 0 if a < 3 else a) for a in range(4) for s in range(1, 13)]
    members = spark.createDataFrame(rows, "a long, words long, s int, bucket long, root long")
    bits = bytearray(bytes(order_minhash.BITS // 8))
    profile = spark.createDataFrame([(a, bits) for a in range(4)], "_a long, bits binary")
    found = order_minhash._tile_texts(members, profile, 0.8)
    # lists of buckets are made flat above the join with the bits, not below it
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("explode(tiles") < plan.find("Join")
    assert sorted((r["a"], r["s"]) for r in found.collect()) == sorted((a, s) for a, _, s, _, _ in rows)


def test_words_are_answered_a_part_of_the_chunks_at_a_time(spark, tmp_path, monkeypatch):
    import os

    from priceloom.functions.scale import settle, shared_folder

    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 40)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"one two {i % 7} three {i % 5} four") for i in range(200)], "doc_id long, text string").coalesce(1).write.parquet(path)
    answered, there, chunks = [], [], set()

    def watched(df, label):
        out = settle(df, label)
        if label == "lm-chunks":
            chunks.update(r["chunk"] for r in out.select("chunk").collect())
        if label == "lm-word-values":
            answered.append({r["chunk"] for r in out.select("chunk").distinct().collect()})
            there.extend(x for x in os.listdir(shared_folder(spark).removeprefix("file://")) if x.startswith(("lm-pairs-", "lm-seats-")))
        return out

    monkeypatch.setattr(pitman_yor, "settle", watched)
    assert pitman_yor.score_texts(spark.read.parquet(path)).count() == 200
    assert len(answered) == pitman_yor.PARTS and not answered[0] & answered[1] and answered[0] | answered[1] == chunks
    # what the answers no longer need has gone: pairs and their seating
    assert there == []
