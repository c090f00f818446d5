"""Periodic runs, token counts and ranked search against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import periodic, ranked, token_counts

ODD = [
    None, "", "  \n\t ", "one", "It's the DOG'S dog'll'd we're''s 's", "x" * 300, "word " * 3000, "Ünïcödé ÇA İstanbul ΣΑΣ ςσ straße ŉ ſ",
    "é ́a café  nbsp  a b", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|endof text|>", "日本語 テスト 한국어 🙂🙂 ½ ² ٣ 12345 a1b2",
    "--'' ''' 'tis !!??.. $#@ a_b c-d", "\x00\x01a\x1cb\x1dc\x7f\x85d e", "A" * 70 + " b", "Éa" * 40,
]
COLUMNS = "doc_id long, text string, key string, size long, id string, term string, n_words long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1, "i", "t", 2) for i, t in enumerate(texts)], COLUMNS)


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words():
    rnd = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(1, 6)):
            w = []
            while len(w) < rnd.randint(0, 90):
                unit = [rnd.randint(0, rnd.choice([1, 2, 9])) for _ in range(rnd.randint(1, 7))]
                w += unit * rnd.randint(1, 7) + unit[: rnd.randint(0, len(unit))]
            docs.append(w)
        x = np.array([v for w in docs for v in w], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
        first = np.cumsum([0] + [len(w) for w in docs])
        got = sorted(zip(*(c.tolist() for c in periodic.find_runs(x, doc)), strict=True))
        assert got == sorted((s + first[k], n, q) for k, w in enumerate(docs) for s, n, q in brute_runs(w))
    with pytest.raises(ValueError):
        periodic.find_runs(x, doc, 6, 3)


def test_run_table(spark, monkeypatch):
    rnd = random.Random(2)
    texts = [*ODD, "a b " * 9 + "a", "w " * 5, "w " * 6, "one two three  \n" * 4, " ".join(str(i) for i in range(40_000)) + " z z z z z z"]
    texts += [" ".join(rnd.choice(["p q r", "s", "t t t t", "u\tv", "é"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)] + ["a b " * 9 + "a"]
    docs = table(spark, texts).unionByName(table(spark, texts[-2:]).withColumn("doc_id", F.lit(None).cast("long")))
    monkeypatch.setattr(periodic, "GROUP_CHARS", 2000)
    got = sorted(map(tuple, periodic.run_table(docs).collect()), key=repr)
    want = []
    for doc_id, text in [*enumerate(texts), (None, texts[-2]), (None, texts[-1])]:
        w = [x.decode() for x in (text or "").encode().split()]
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 5000 else sorted(zip(*(c.tolist() for c in periodic.find_runs(np.unique(w, return_inverse=True)[1], np.zeros(n, int))), strict=True))
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        want.append((doc_id, len(runs), s, length, q, s if s is None else 1000 * length // q, digest, hashlib.sha256(collapse(w, runs).encode()).hexdigest()))
    assert got == sorted(want, key=repr) and any(r[1] > 1 for r in want)
    kept = periodic.periodic_runs(docs, ["doc_id", "key", "size"]).filter("doc_id = 15").first()
    assert kept.collapsed == "a b" and [tuple(r) for r in kept.runs] == [(0, 19, 2)] and kept.key == "k"
    assert periodic.run_table(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [token_counts.TABLE, 3])
def test_token_counts(spark, size, monkeypatch):
    own = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    rnd = random.Random(3)
    signs = "aB éÉ'sΣİ<|>́ \n9½-.日ſß"
    texts = [*ODD, *("".join(rnd.choice(signs) for _ in range(rnd.randint(0, 80))) for _ in range(300)), "it's " * 900, ODD[4]]
    docs = table(spark, texts).repartition(20)  # more summaries than one task merges
    monkeypatch.setattr(token_counts, "SLICE", 100)
    got = sorted(map(tuple, token_counts.token_counts(docs, ["doc_id", "size"], size=size).collect()))
    assert got == [(i, 1, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    rows = {r.doc_id: r for r in token_counts.count_table(docs.unionByName(table(spark, [None]).withColumn("doc_id", F.lit(None).cast("long")))).collect()}
    assert rows[None].n_tokens == rows[None].n_bytes == 0 and rows[6].over_limit and not rows[4].over_limit
    assert rows[8].n_bytes == len(ODD[8].encode()) and rows[9].n_tokens == len(own.encode(ODD[9], add_special_tokens=False).ids)
    assert token_counts.count_table(docs.limit(0)).count() == 0 and token_counts.frequent(docs.limit(0)) == []


def test_frequent_pre_tokens_and_worker_cache(spark):
    texts = ["the cat " * 500, "the dog", *(f"w{i}x" for i in range(200)), "the"]
    assert {"the", "cat"} <= set(token_counts.frequent(table(spark, texts).repartition(40), size=4))
    known = token_counts.Lengths(token_counts.pack(["the"], token_counts.TOKENIZER), token_counts.TOKENIZER, room=3)
    assert known.total(["the", "a", "b", "c"]) == 4 and len(known) == 4
    assert known.total(["the", "d", "the"]) == 3 and set(known) == {"the", "d"}  # the cache starts afresh, the table stays
    assert known.total(["z" * 100]) == len(known.own.own.encode("z" * 100, add_special_tokens=False).ids) and set(known) == {"the", "d"}


def terms(t):
    return (t or "").encode().translate(ranked._FOLD).split()


def brute_search(docs, items, k):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    held = [x for x in held if x[2]]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in held:
            m = 75 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_ranked_search(spark):
    rnd = random.Random(4)
    vocab = [f"w{min(rnd.randrange(200), rnd.randrange(200), rnd.randrange(200))}" for _ in range(3000)] + ["Été", "A9"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([2, 30, 80]))) for _ in range(300)]
    texts += [texts[3]] * 40 + [None, "", " ,.", "ÉTÉ été", "w0 " * 5000]  # ties, no terms, a long text
    docs = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (5, texts[3]), (5, texts[3])]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 4, 40])))) for i in range(25)]
    items += [(50, texts[3]), (51, texts[3] + " " + texts[3]), (52, None), (53, ""), (54, "unseen Words"), (55, "Été, a9! w0"), (50, texts[3])]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, term string, block long").repartition(3)
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, query long, chunk long")
    want = sorted(brute_search(docs, items, 20), key=repr)
    assert sorted(map(tuple, ranked.search_table(frame, bench).collect()), key=repr) == want
    index = ranked.build_index(frame, block_words=400)  # many blocks and many chunks
    assert index.filter("kind = 0").count() >= 3
    asked = bench.select(F.monotonically_increasing_id().alias("query"), "item_id", "text")
    small = ranked.search(index, asked, k=7, query_terms=30).join(asked, "query").select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, small.collect()), key=repr) == sorted(brute_search(docs, items, 7), key=repr)
    none, blank = frame.limit(0), bench.limit(0)
    assert ranked.search_table(none, bench).count() == ranked.search_table(frame, blank).count() == ranked.search_table(none, blank).count() == 0


def test_best_first_search_leaves_documents_unread():
    rng = np.random.default_rng(0)
    size = 4000
    docs = [np.sort(rng.choice(size, 1500, replace=False)) for _ in range(3)]
    counts = [rng.integers(1, 4, 1500) for _ in range(3)]
    index = ranked.Postings([b"a", b"b", b"c"], docs, counts, [900, 400, 300], rng.integers(80, 200, size))
    total = np.zeros(size, np.int64)
    np.add.at(total, index.doc, index.impact)
    seen = []
    whole = index.maximum
    index.maximum = lambda a, b: seen.append(len(a)) or whole(a, b)
    got, score = index.top([b"a", b"b", b"c", b"d"], [1, 1, 1, 1], 10)
    order = np.lexsort((np.arange(size), -total))[:10]
    assert got.tolist() == order.tolist() and score.tolist() == total[order].tolist() and sum(seen) < 3 * size
