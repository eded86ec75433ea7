"""Token files, periodic runs and source divergence: brute force, round trips and edge cases on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapestudy.llm import divergence, periods, tokenfiles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdefghij"


def key(r):
    return tuple((x is None, x) for x in r)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def sentence(r, n, vocab=60):
    return " ".join(r.choice(LETTERS) + str(r.randrange(vocab)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    texts = [sentence(r, r.randrange(1, 200)) for _ in range(60)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "one", "| " * 130, "a b " * 40 + "c " + "a b " * 40, "ünï çödé　wide\x1cspace   #*$ <|endoftext|>", "\x00", "A\n\nA\n B\n\n\nB ", "z" * 30000, sentence(r, 6000)]
    out = [(i * 3, t, [None, "en", "de"][i % 3], ["s0", None, "s1", "é"][i % 4], 1) for i, t in enumerate(texts)]
    return out + [out[5], out[5], (9, "other text of a known id", "en", "s0", 1), (None, "no id", "fr", "lone", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = ["n", "blob", "crc", "row", "part", "file", "start", "length", "period", "g", "chunk", "term", "counts", "docs", "item", "value", "rank", "ids"]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", *[f"'x' AS {c}" for c in clashing])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# token files

def test_pieces_equal_library():
    mine, theirs, r = tokenfiles.PieceIds(BYTES), Tokenizer.from_file(BYTES), random.Random(2)
    parts = ["a", "th", "ing", " ", " ", "  ", "\n", "\n\n", " \n", "\t", "　", "\x85", "'s", "22", "é", "ß", "$", "!!", "一", "😀", "́", "<|endoftext|>", " word", "\nLine"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(3000)]
    assert [x.tolist() for x in mine.encode(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, docs, rows, none):
    t = Tokenizer.from_file(BYTES)
    stored = tokenfiles.store(docs, BYTES, sample_docs=30, sample_ids=64, dictionary_size=2048, file_bytes=2000)
    ids = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x, *_ in rows]
    got = tokenfiles.digest(stored, spark).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x), crc(x)) for d, x in ids)
    # starts: gapless, in ascending doc_id order, rows without an id first
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None and last == -1 or r.doc_id >= last)
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokenfiles.read(stored, spark).collect()) == Counter((d, tuple(x)) for d, x in ids)
    assert stored.manifest(spark).count() > 1 and len(stored.dictionary) > 0
    again = tokenfiles.open_stored(spark, stored.folder)
    some = tokenfiles.read_some(again, spark, [9, 15, 30, 1, 10_000]).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in some) == Counter((d, tuple(x)) for d, x in ids if d in (9, 15, 30))
    starts = {(r.doc_id, r.start) for r in got}
    assert all((r.doc_id, r.start) in starts for r in some)
    wrong = tokenfiles.Stored(stored.folder, 2, stored.dictionary + b"x")
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.TokenFile(wrong, stored.manifest(spark).first().file)
    assert tokenfiles.digest(tokenfiles.store(none, BYTES), spark).count() == 0


# periodic runs

def runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_equal_brute_force():
    r = random.Random(4)

    def words(n, k):
        kind = r.randrange(5)
        if kind == 0:
            return [b"%d" % r.randrange(k) for _ in range(n)]
        if kind == 1:
            out = []
            while len(out) < n:
                unit = [b"%d" % r.randrange(k) for _ in range(r.randrange(1, 40))]
                out += (unit * r.randrange(1, 6))[:r.randrange(1, 120)]
            return out
        if kind == 2:
            a, b = [b"a"], [b"a", b"b"]
            while len(b) < n:
                a, b = b, b + a
            return b[:n]
        if kind == 3:
            return (([b"a", b"b"] * r.randrange(2, 30) + [b"a"]) * 6)[:n] + [b"b"]
        half = [b"%d" % r.randrange(2) for _ in range(n)]
        return half + half[r.randrange(n):] * 2

    for _ in range(60):
        docs = [words(r.randrange(1, 200), r.choice([1, 2, 3, 5])) for _ in range(r.randrange(1, 8))] + [[]]
        for d, got in zip(docs, periods.runs_of(docs)):
            assert [tuple(x) for x in got.tolist()] == runs(d), d


def test_run_digest(docs, none, rows):
    def expected(change):
        for d, text, *_ in rows:
            w = change(d, (text or "").encode().split())
            found = runs(w)
            gone = {i for s, n, q in found for i in range(s + q, s + n)}
            best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
            yield (d, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
                   hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())

    def planted(doc, w):
        h = zlib.crc32(str(doc).encode())
        if doc is None or h % 10 or not w:
            return w
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]

    short = [r for r in rows if len(r[1] or "") < 5000]
    few = docs.where("text IS NULL OR length(text) < 5000")
    rows[:], kept = short, rows[:]
    try:
        same(periods.run_digest(few, change=periods.planted), list(expected(planted)))
        same(periods.run_digest(few), list(expected(lambda d, w: w)))
    finally:
        rows[:] = kept
    assert periods.run_digest(none).count() == 0
    listed = periods.periodic_runs(docs.where("doc_id = 195"))
    assert {tuple(r)[1:] for r in listed.collect()} == set(runs((rows[65][1]).encode().split()))
    assert periods.collapse_runs(docs.where("doc_id = 192")).first().text == "|"


# source divergence

def audit(rows, least, top=10):
    share = lambda c, below: 1 + 1_000_000_000 * (c + 2) // below
    docs, count, groups = defaultdict(set), Counter(), set()
    for i, (_, text, lang, source, _) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
            docs[lang, t].add(i)
            count[lang, source, t] += 1
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= least]
        sources = [s for x, s in groups if x == lang]
        p = {}
        for s in sources:
            below = sum(count[lang, s, t] for t in kept) + 2 * len(kept)
            p[s] = {t: share(count[lang, s, t], below) for t in kept}
        total = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        below = sum(total.values()) + 2 * len(kept)
        q = {t: share(total[t], below) for t in kept}
        gap = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s, t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(terms)[:top])]
    return out


@pytest.mark.parametrize("least", [10, 3, 1])
def test_divergence(docs, none, rows, least):
    before = divergence.WORDS, divergence.CHUNKS, divergence.ROWS, divergence.TERMS
    divergence.WORDS, divergence.CHUNKS, divergence.ROWS, divergence.TERMS = (300, 1000, 7, 5) if least != 10 else before  # many slices and buffers
    try:
        same(divergence.divergence(docs, least=least), audit(rows, least))
    finally:
        divergence.WORDS, divergence.CHUNKS, divergence.ROWS, divergence.TERMS = before
    assert divergence.divergence(none).count() == 0


def test_spellings_of_a_term_share_documents(spark):
    """A document with many spellings counts once; spellings of nine documents each keep a term when ten have one of them."""
    data = [(i, "Word word, (word) wórd-word", "en", "a", 0) for i in range(9)] + [(20 + i, "rare rare.", "en", "b", 0) for i in range(6)] + [(40 + i, "x rare! RARE", "en", "b", 0) for i in range(4)]
    out = divergence.divergence(spark.createDataFrame(data, SCHEMA)).where("part = 'term'").collect()
    assert {(r.source, r.item) for r in out} == {("b", "rare")} or not out
    groups, _, kept = divergence.kept_terms(spark.createDataFrame(data, SCHEMA))
    assert [bytes(r.term) for r in kept.collect()] == [b"rare"] and groups == [("en", "a"), ("en", "b")]


def test_long_division():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randrange(1, 9 * 10**15)
        count = r.randrange(0, total + 1)
        assert int(divergence.share(np.array([count]), total)[0]) == 1 + 1_000_000_000 * count // total
