"""Dealt operators on small fixtures: brute force, round trips, nulls, empties, long texts, ties, repeats, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tapestudy.llm import bpe, licenses, lm, mil, neardup, packing, quality, simhash, substring, topk, urls
from tapestudy.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LETTERS = "abcdefghij"


def sentence(r, n, vocab=200):
    return " ".join("".join(r.choice(LETTERS) for _ in range(r.randrange(1, 7))) + str(r.randrange(vocab)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty, white space, odd characters, a long text, a repeated row."""
    r = random.Random(5)
    shared = sentence(r, 80)
    base = sentence(r, 300)
    words = base.split()
    texts = [sentence(r, r.randrange(1, 250)) for _ in range(40)]
    texts += [base] * 3 + [" ".join(w if i % 90 else "x" for i, w in enumerate(words)), base.replace(" ", "\n", 3)]
    texts += [sentence(r, 20) + " " + shared + " " + sentence(r, 15) for _ in range(5)] + [shared[20:], shared]
    texts += [None, "", " \t\n\x0b\x0c\r ", "| " * 130, "one", "two words", "ünï çödé\u3000wide\x1cspace \u00a0 #*$ <|endoftext|> <|startoftext|>", "\x00", "A\n\nA\n B\nB ", sentence(r, 9000), "z" * 30000]
    out = [(i * 3, t, [None, "en", "de"][i % 3], ["s0", None][i % 7 == 0], 1) for i, t in enumerate(texts)]
    return out + [out[40]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = ["n_words", "h", "fp", "words", "copy", "starts", "key", "_doc", "_gone", "_row", "label", "score", "kept", "_w", "n", "ids", "piece", "length", "token"]
    return df.selectExpr("*", *[f"'x' AS {c}" for c in clashing])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def key(r):
    return tuple((x is None, x) for x in r)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def test_top_k(spark):
    r = np.random.default_rng(3)
    data = [(i, [float(x) for x in r.normal(0, 0.2, 12)]) for i in range(300)]
    data += [(300 + i, list(data[i][1])) for i in range(30)]  # ties
    data += [(400, None), (401, [0.1, None] + [0.0] * 10), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []), (405, [0.5, 0.25]), (7, list(data[7][1])), (None, [1.0] * 12)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS score")
    vectors = []
    for i, v in data:
        if i is not None and v is not None and None not in v and np.isfinite(v).all():
            x = np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)
            vectors.append((i, np.pad(x, (0, 12 - len(x)))))
    want = []
    queries = {(i, tuple(v)) for i, v in vectors if i % 20 == 0 or i == 405}
    for q, v in queries:
        scored = sorted(((-int(np.dot(v, x)), i) for i, x in vectors if i != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for lists in (1, 4):
        same(topk.top_k(df, df.where("vec_id % 20 = 0 OR vec_id = 405"), lists=lists, block=7), want)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id bigint, embedding array<double>"), df.where("vec_id = 0")).collect()


def test_bpe_equals_library(docs, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = []
    for d, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe.round_trip_digest(docs, path), want)
    tokens = bpe.encode(docs, path)
    same(bpe.decode(tokens, path), [(d, text or "") for d, text, *_ in rows])
    assert bpe.round_trip_digest(none, path).count() == 0


def test_bpe_random_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, theirs, r = bpe.ByteBPE(path), Tokenizer.from_file(path), random.Random(2)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "'s", "'re", "1", "22", "é", "ß", "$", "!!", "一", "😀", "\t", "ing", "²", "\u0301", "\x85", "\u2003"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 40)))
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def removed(data, size):
    first = {}
    for d, text, *_ in data:
        w = words(text)
        for i in range(len(w) - size + 1):
            g = tuple(w[i:i + size])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, text, *_ in data:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < d:
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("size", [50, 7])
def test_substring_dedup(docs, none, rows, size):
    same(substring.kept_words(docs, min_words=size), removed(rows, size))
    assert substring.kept_words(none).count() == 0


def test_substring_common_anchors(spark, rows):
    """Anchors above the group size take the way by window."""
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    compact = substring._compact(df)
    few = {(r.doc_id, r.copy): sorted(r.starts or []) for r in substring.repeated_windows(df, compact, 50, group=1).collect()}
    many = {(r.doc_id, r.copy): sorted(r.starts or []) for r in substring.repeated_windows(df, compact, 50, group=1000).collect()}
    substring.TABLE, limit = 0, substring.TABLE  # the way for anchors with more repeated windows than a table holds
    joined = {(r.doc_id, r.copy): sorted(r.starts or []) for r in substring.repeated_windows(df, compact, 50, group=1).collect()}
    substring.TABLE = limit
    assert few == many == joined and few


def test_substring_cut_keeps_columns(docs, none, rows):
    out = {(r.doc_id, len(words(r.text))): r for r in substring.remove_repeated(docs).collect()}
    want = {(d, n - gone): n for d, n, gone, _ in removed(rows, 50) if n - gone or not gone}
    assert set(out) == set(want) and list(next(iter(out.values())).asDict()) == docs.columns
    assert all(r.copy == "x" and r._doc == "x" for r in out.values())
    assert substring.remove_repeated(none).count() == 0


def test_quality_classifier(spark, none):
    r = random.Random(1)
    data, labels = [], []
    for i in range(160):
        good = i % 3 > 0
        w = sentence(r, r.randrange(1, 200)).split()
        data.append((i, " ".join(w if good else [x + "###" for x in w]), "en", "s", 1))
        labels.append((i, int(good)))
    df = spark.createDataFrame(data + [(900, None, None, None, None), (901, "", None, None, None), (902, sentence(r, 20000), None, None, None), data[0]], SCHEMA)
    known = spark.createDataFrame(labels[:100] + [(0, 0 + labels[0][1]), (5000, 1), (3, None), (None, 1)], "doc_id bigint, quality int")
    model = mil.train(df, known)
    scored = mil.scores(df, model).collect()
    found = {x.doc_id: x.score for x in scored}
    assert len(scored) == len(data) + 4 and all(0 <= s <= 1 for s in found.values())
    held = [(found[i] >= 0.5) == bool(q) for i, q in labels[100:]]
    assert sum(held) >= 0.95 * len(held)
    kept = mil.keep_good(df, model, 0.5)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {d for d, s in found.items() if s >= 0.5}
    assert mil.train(df, known.limit(0)) is None and {x.score for x in mil.scores(df, None).collect()} == {0.5}
    assert mil.scores(none, model).count() == 0
    assert mil.train(df, known, max_documents=20) is not None
    assert mil.scores(df, mil.train(df, known.where("quality = 1"))).where("score < 0.5").count() <= 2


def test_attention_gradient():
    r = np.random.default_rng(0)
    m = mil.GatedAttention(hidden=5, attention=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    counts, starts, y = r.integers(0, 3, (7, mil.WIDTH)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = m.forward(counts, starts)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))
    g = m.gradient(counts, starts, y, 0.0)
    for name, at in (("E", (3, 2)), ("V", (1, 1)), ("U", (4, 0)), ("w", (1,)), ("c", (2,)), ("b", (0,)), ("e", (1,))):
        old = m.p[name][at]
        m.p[name][at] = old + 1e-4
        up = loss()
        m.p[name][at] = old - 1e-4
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-3


def test_licenses(spark, docs, none):
    notices = list(licenses.NOTICES.items())
    data = [(0, "text " * 50 + notices[0][1] + " and more"), (1, "LICENSED under the apache license version 2.0"), (2, "Licensed under the Apache License, own Version 2.0."),
            (3, notices[2][1] + "\n" + notices[1][1] + "\n" + notices[1][1]), (4, "licensed words only"), (5, None), (6, "")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 AS license")
    found = sorted(((r.doc_id, r.license, r.start_word, r.end_word, r.matched_words) for r in licenses.scan_licenses(df).collect()))
    assert found == [(0, "Apache-2.0", 50, 57, 7), (1, "Apache-2.0", 0, 7, 7), (2, "Apache-2.0", 0, 8, 7), (3, "GPL-3.0", 0, 12, 12), (3, "MIT", 12, 17, 5), (3, "MIT", 17, 22, 5)]
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(df, {"short": "mit license", "empty": ""}).where("doc_id = 3").count() == 2


def components(prints, radius):
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if bin((x ^ y) & (1 << 64) - 1).count("1") <= radius:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def test_fingerprints(docs, none, rows):
    want = []
    for d, text, *_ in rows:
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        want.append((d, value - (1 << 64) if value >> 63 else value))
    same(simhash.fingerprints(docs), want)
    assert simhash.near_duplicate_components(simhash.fingerprints(none)).count() == 0


@pytest.mark.parametrize("shard", [256, 1])
def test_simhash_components(spark, shard):
    """With shard=1 every bucket takes the way for large ones."""
    r = random.Random(8)
    prints = [(i, r.getrandbits(64)) for i in range(60)]
    for i in range(60, 260):
        x = r.choice(prints)[1]
        for _ in range(r.randrange(0, 4)):
            x ^= 1 << r.randrange(64)
        prints.append((i, x))
    r.shuffle(prints)
    signed = [(d, x - (1 << 64) if x >> 63 else x) for d, x in prints]
    want = components(prints, 2)
    df = spark.createDataFrame(signed + [signed[3]], "doc_id bigint, fp bigint")
    same(simhash.near_duplicate_components(df, shard=shard), [(d, x, want[d]) for d, x in signed + [signed[3]]])
    null = simhash.near_duplicate_components(df.unionByName(df.limit(1).selectExpr("CAST(NULL AS bigint) AS doc_id", "7 AS fp")))
    assert null.where("doc_id IS NULL").count() == 1


def test_long_chains(spark):
    r = random.Random(4)
    ids = list(range(500))
    r.shuffle(ids)
    links = [(a, b) for a, b in zip(ids[:300], ids[1:300])] + [(a, b) for a, b in zip(ids[300:], ids[301:])] + [(5, 5), (None, 3)]
    out = {x.node: x.root for x in connected_components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)).collect()}
    for part in (ids[:300], ids[300:]):
        assert {i: min(part) for i in part if i != min(part)} == {i: out[i] for i in part if i in out}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("shard", [2000, 3])
def test_near_duplicates(spark, docs, none, rows, shard):
    r = random.Random(12)
    base = sentence(r, 400).split()
    data = list(rows)
    for i in range(25):
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(len(w))] = "new"
        data.append((1000 + i, " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(data, SCHEMA)
    sets = {d: set(np.unique(simhash.shingle_hashes(t or "", 5)).tolist()) for d, t, *_ in data}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] == sets[b] or n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    same(neardup.near_duplicate_groups(df, shard=shard), [(d, find(d)) for d in ids if find(d) != d])
    if shard == 2000:
        kept = neardup.one_of_each_group(docs)
        assert kept.columns == docs.columns and neardup.one_of_each_group(none).count() == 0
        assert kept.where("doc_id IS NULL").count() == 0


def test_near_duplicates_with_repeated_runs(spark):
    """Copies in which a repeated run is shorter and one word is another: every pair of similarity 0.8 is linked."""
    r = random.Random(23)
    texts = []
    for n in (80, 120, 200, 300, 400):
        for run in (20, 60, 100):
            w = [f"w{r.randrange(10**9)}" for _ in range(n)]
            at, changed = r.randrange(n), r.randrange(n)
            texts.append(" ".join(w[:at] + ["-"] * run + w[at:]))
            w[changed] = "other"
            texts.append(" ".join(w[:at] + ["-"] * r.choice((5, 10)) + w[at:]))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert pairs == [(i, i + 1) for i in range(0, len(texts), 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    same(neardup.near_duplicate_groups(df), [(j, i) for i, j in pairs])


def test_urls(spark):
    rules = [urls.Rule(*x) for x in [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "", "block"), ("org", "/a", "block")]]
    cases = [("http://EXAMPLE.com/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
             ("http://x.com", "x.com", "", None, "allow"), ("http://x.com/", "x.com", "/", "com/", "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
             ("https://a.net", "a.net", "", "net", "block"), ("https://a.network/", "a.network", "/", None, "allow"), ("http://a.org/abc", "a.org", "/abc", "org/a", "block"), (None, "", "", None, "allow"),
             ("", "", "", None, "allow"), ("no scheme.com/", "", "", None, "allow"), ("x://É.COM/Ä#://y.net/", "É.com", "/Ä", "com/", "allow"), ("http://a.com?x=/en/", "a.com", "", None, "allow"), ("a://b://c.com/", "b:", "//c.com/", None, "allow")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(0, cases[0][0]), (None, "http://x.com/")], "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS rule")
    want = [(i, *c[1:]) for i, c in enumerate(cases)] + [(0, *cases[0][1:]), (None, "x.com", "/", "com/", "allow")]
    same(urls.filter_urls(df, rules), want)
    assert urls.filter_urls(df.limit(0), rules).count() == 0
    assert urls.filter_urls(df, []).where("rule IS NULL AND verdict = 'allow'").count() == len(want)
    index, always = urls.rule_index(rules, {"com": 9, "example": 5, "www": 7, "en": 6, "net": 1, "org": 1})
    assert index == {"com": [0], "example": [1, 2], "net": [3], "org": [4]} and always == []


def test_packing(docs, none, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, capacity=512).collect()
    want = []
    for d, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, i, s, len(ids[s:s + 512]), zlib.crc32(ids[s:s + 512].tobytes())) for i, s in enumerate(range(0, len(ids), 512))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack_documents(none, path).count() == 0


def test_fullest_combination():
    r = random.Random(3)
    for _ in range(200):
        counts = Counter(r.randrange(1, 30) for _ in range(r.randrange(1, 9)))
        room = r.randrange(0, 60)
        sums = {0}
        for x, n in counts.items():
            for _ in range(n):
                sums |= {s + x for s in sums}
        found = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert all(n <= counts[x] for x, n in found) and sum(x * n for x, n in found) == max(s for s in sums if s <= room)


def test_lm(docs, none, rows):
    held = {d for d, *_ in rows if d % 4 == 0}
    train = docs.where("doc_id % 4 <> 0")
    counts = Counter()
    for d, text, *_ in rows:
        if d not in held:
            counts.update(lm.tokens_of(text or ""))
    total, distinct = sum(counts.values()), len(counts)
    for frequent in (200_000, 5):
        got = sorted(lm.score(docs, train, frequent=frequent).collect(), key=lambda r: r.doc_id)
        for r, (d, text, *_) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
            tokens = lm.tokens_of(text or "")
            assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (d, len(tokens), sum(counts[t] > 0 for t in tokens), total)
            assert abs(r.base_score - sum(np.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)) < 1e-6 * max(1, len(tokens))
            assert np.isfinite(r.score) and r.score <= 0
    assert lm.score(none, none).count() == 0
    assert {r.train_tokens for r in lm.score(docs, none).collect()} == {0}


def test_lm_is_a_distribution():
    """The class factor sums to one, and so does the word factor over known words and the reserved place."""
    r = np.random.default_rng(1)
    classes = lm.Classes([b"the", b"of"])
    codes = classes.codes([b"the", b"cat", b"of", lm.END, b"cat", lm.END])
    rows, target = lm._histories(codes, np.array([0, 4]))
    weights, bias = r.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32), np.zeros(lm.CLASSES, np.float32)
    p = np.exp([lm._log_chosen(weights, bias, rows, np.full(len(target), c)) for c in range(lm.CLASSES)])
    assert np.allclose(p.sum(axis=0), 1, atol=1e-5) and rows[:, 0].tolist() == rows[:, 4].tolist()
    assert target.tolist() == [1, classes.of(b"cat"), 2, 0, classes.of(b"cat"), 0]


def test_lm_rows_grow():
    """Words before that the least table cannot tell apart have rows of their own in a larger one."""
    assert [lm.rows_for(n) for n in (0, 8192, 8193, 100_000)] == [8192, 8192, 16384, 1 << 17]
    assert lm.rows_for(10**9) == lm.MAX_ROWS and lm.rows_for(100_000, 50_000) == 32768
    codes = np.array([zlib.crc32(str(i).encode()) << 8 | 30 for i in range(50_000)])
    few, many = (len(np.unique(lm._histories(codes, np.array([0]), n)[0][1])) for n in (lm.ROWS, lm.rows_for(50_000)))
    assert few <= 8192 and many > 30_000 and lm.FEATURES == len(lm._histories(codes, np.array([0]))[0]) == 4
    assert lm.CLASSES == 65


def test_lm_learns(spark):
    r = random.Random(9)
    def text(kind):
        a = {"x": ["thing", "sing", "ring", "king"], "y": ["ladung", "wohnung", "zeitung", "heizung"]}[kind]
        return " ".join(r.choice(a) for _ in range(40))
    df = spark.createDataFrame([(i, text("xy"[i % 2])) for i in range(300)], "doc_id bigint, text string")
    got = lm.score(df, df.where("doc_id < 200")).where("doc_id >= 200").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > 0.8 * got.b


def test_quality_rules(docs, none, rows):
    got = {r.doc_id: r for r in quality.quality_verdicts(docs.select("doc_id", "text", "lang", "source")).collect()}
    for d, text, *_ in rows:
        w, t = [x.decode() for x in words(text)], text or ""
        lines = [x for x in t.split("\n") if x.encode().split()]
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        twice = Counter(grams)
        cover = {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 5)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)), text
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    assert {r.n_words for r in kept.collect()} == {"x"}
    assert quality.quality_verdicts(none).count() == 0 and quality.quality_filter(none).count() == 0


def test_quality_rules_adapt(spark):
    """A measure that is usual in one group and not in another is rejected only where it is not."""
    r = random.Random(6)
    plain = [(i, sentence(r, 60), "en", "a", 1) for i in range(50)]
    rich = [(100 + i, sentence(r, 60).replace("1", "#$"), "en", "b", 1) for i in range(50)]
    odd = (999, sentence(r, 60).replace("1", "#$").replace("2", "|&"), "en", "a", 1)
    kept = {x.doc_id for x in quality.quality_filter(spark.createDataFrame([*plain, *rich, odd], SCHEMA)).collect()}
    assert kept == {d for d, *_ in plain + rich}
