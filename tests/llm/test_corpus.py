"""Corpus operators against brute force on small, awkward tables: nulls, empty and long texts, repeats, clashing columns, empty input."""

import gzip
import hashlib
import io
import json
import random
import re
import sys
import zipfile
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from tidemark.llm import archives, chat, decontam, lines, mixing, near, quality, sharding, token_files, toxicity  # noqa: E402
from tidemark.llm.common import components, with_row, word_count  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, doc string"
PASSAGE = " ".join(f"bench{i}" for i in range(30))


def some_texts():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["été", "naïve"]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 120))) for _ in range(40)]
    base = [re.sub(r"(( \S+){9}) ", r"\1\n", t) for t in base]
    near_copies = [base[0] + f" end{i}" for i in range(6)] + [base[1].replace("w1", "x1", 1)]
    rows = [*base, *base[:5], base[2], *near_copies]
    rows += ["", None, None, "  \n\t ", "one", "one", "a b c d", PASSAGE, "Intro. " + PASSAGE + " outro", "x " * 30000, base[3] + "\n" + base[4] + "\n" + base[3]]
    rows += ["you idiot you stup1d fool " * 3, "what an ιdiot"]
    return rows


@pytest.fixture(scope="module")
def rows():
    texts = some_texts()
    out = [(i, t, "en", f"s{i % 4}" if i % 7 else None, None, "r", "d") for i, t in enumerate(texts)]
    return out + [(3, texts[3], "en", "s3", 9, "r", "d")] * 2 + [(None, texts[6], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, rows):
    data = [(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None] + [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (10, "A, b c D!"), (2, None), (3, ""), (1, PASSAGE)], "item_id long, text string")


def by_row(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_toxicity(docs, none, labels, rows):
    lexicon = toxicity.Lexicon(word={"idiot": 4.0, "stupid": 3.0}, stem={"mor": 2.0}, exceptions={"idiot savant", "more"}, coefficients=(-2.0, 1.0, 1.0, 1.0))
    machine = lexicon.automaton()
    hits = lambda t: [(t[s:], w) for s, w in toxicity.find(t, machine)]
    assert hits("an 1d10t.") == [("1d10t.", 4.0)] and hits("іdіоt") == [("іdіоt", 4.0)] and hits("$tup1d$$$")[0][1] == 3.0
    assert hits("idiots") == [] and hits("IDIOT savant") == [] and hits("more moron") == [("moron", 2.0)] and hits("") == []
    assert toxicity.score("idiot", machine, lexicon.coefficients) > toxicity.score("idiot " + "fine " * 200, machine, lexicon.coefficients)
    got = toxicity.toxicity_table(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert toxicity.toxicity_table(none, labels).count() == 0 and toxicity.toxicity_table(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_quality(docs, none, rows):
    def brute(t):
        t = t or ""
        w = WORDS.findall(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        full = [x for x in t.split("\n") if WORDS.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), failed

    got = quality.quality_table(docs)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert got.filter("kept and base_failed").count() == 0 and got.filter("kept").count() > 30
    assert quality.quality_table(none).count() == 0 and quality.kept_documents(docs).columns == docs.columns


def test_quality_em_finds_the_accurate_rule(spark):
    rnd = random.Random(1)
    votes = []
    for i in range(3000):
        good = i % 4 > 0
        votes.append((0 if good else rnd.choice([-1, -1, 0]), 0 if good else rnd.choice([-1, 0, 0]), rnd.choice([1, 1, 0]) if good else rnd.choice([0, 0, 1])))
    share, table = quality.fit(spark.createDataFrame(votes, "a int, b int, c int"), ["a", "b", "c"])
    assert 0.65 < share < 0.92 and table["a"][-1][1] > table["b"][-1][1] > table["b"][-1][0]


def test_sharding(docs, none, rows):
    got = sharding.shard_table(docs, 5).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    groups = {}
    for r in got:
        if r.size > 8:
            groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) == 0
    assert sharding.shard_table(none).count() == 0 and set(docs.columns) < set(sharding.sharded(docs, 3).columns)


@pytest.mark.parametrize("groups, single", [([90] * 4 + [2] * 20, 200), ([50] * 12, 100), ([220, 90, 90, 40, 40], 120)])
def test_sharding_keeps_groups_that_fit(spark, groups, single):
    texts = [f"group {g}" for g, n in enumerate(groups) for _ in range(n)] + [f"single {i}" for i in range(single)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_table(df, 6).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    parts = {}
    for r in got:
        parts.setdefault(texts[r.doc_id], Counter())[r.shard] += 1
    room = len(texts) // 6
    assert all(len(parts[f"group {g}"]) == 1 for g, n in enumerate(groups) if n <= room)
    assert all(len(parts[f"group {g}"]) <= 4 for g, n in enumerate(groups))


def test_flows_stay_even():
    rnd = random.Random(3)
    for _ in range(200):
        wish = {(s, t): rnd.randint(0, 9) for s in range(4) for t in range(4) if s != t}
        free = {s: rnd.randint(0, 6) for s in range(4)}
        moved, sent = sharding.flows(wish, free, 4)
        for k in range(4):
            flow = [sum(v for c, v in f.items() if c[i] == k) for f in (moved, sent) for i in (0, 1)]
            assert flow[0] + flow[2] == flow[1] + flow[3] and flow[2] <= free[k]
        assert all(0 <= moved[c] <= wish[c] for c in wish)


def test_token_files(spark, docs, none, rows):
    own = token_files.known().own
    rnd = random.Random(2)
    for _ in range(2000):
        t = "".join(rnd.choice(["a", "B", " ", "  ", "\n", "é", "'s", "\t", "1", ".", "\xa0", "\0", "<|endoftext|>", ",", "日"]) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(token_files.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray([*own.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert by_row(token_files.token_table(docs), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_files.token_table(none).count() == 0
    path = token_files.fresh_path(spark, "orc")
    token_files.write_tokens(docs, path)
    assert token_files.lookup(spark, path, [3, 999]).count() == 3


def test_decontamination(docs, none, benchmark, rows):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    items = [("1", split(PASSAGE)), ("10", ["a", "b", "c", "d"])]

    def brute(t):
        w, hit, names = split(t), set(), set()
        for name, item in items:
            k = min(13, len(item))
            wins = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    names.add(name)
        return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    got = decontam.contamination_table(docs, benchmark)
    assert by_row(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert decontam.contamination_table(none, benchmark).count() == 0
    assert decontam.contamination_table(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    kept = decontam.without_benchmark(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not brute(r[1])[4] for r in rows)
    index = decontam.build_index(docs, ["doc_id"], block_words=50)
    assert by_row(decontam.in_documents(decontam.matches(index, benchmark, item_bytes=1), decontam.index_documents(index), ["doc_id"]), "doc_id", "n_hit") == by_row(got, "doc_id", "n_hit")
    assert decontam.near_matches(index, [("q", ["bench3", "bench5"])], 2).count() == 2
    assert decontam.near_matches(index, [("q", ["bench3", "bench9"])], 2).count() == 0


def test_archives(spark):
    long = "é" * 600
    pages = [(1, "u\n1", long), (2, None, long), (5, "u5", long), (5, "u5", long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (None, "u", long), (7, "u", "x" * 300000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = h == long and i != 5
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert by_row(archives.archive_table(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert archives.archive_table(df.limit(0)).count() == 0


@pytest.mark.parametrize("comment", [b"", b"PK\5\6 a comment with a mark"])
def test_zip_directories(comment):
    out = io.BytesIO()
    archives.store(out.write, [("a", [b"12", b"345"]), ("é/b", [b""])])
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("a") == b"12345" and z.namelist() == ["a", "é/b"]
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.comment = comment
        z.writestr("x", b"hello")
        z.writestr("y", b"hello" * 99, zipfile.ZIP_DEFLATED)
    for raw, name, data in ((out.getvalue(), "a", b"12345"), (plain.getvalue(), "x", b"hello")):
        at, n, method = archives.members(lambda o, k, raw=raw: raw[o : o + k], len(raw))[name]
        assert raw[at : at + n] == data and method == 0
    with pytest.raises(ValueError):
        archives.members(lambda o, k: b"no archive"[o : o + k], 10)


def test_chat(spark):
    odd = ["", "\\### Assistant: </turn> ok", "a\n\n### user: x</turn>\n", "日本 \\\\ ", " lead", "tail ", None]
    turns = [(c, t, "assistant" if t % 2 else ("user" if c else "sys:\\tem"), odd[(c + t) % len(odd)]) for c in range(9) for t in range(c + 1)]
    turns += [(4, 1, "assistant", "again"), (None, 0, None, None), (50, 0, "assistant", "long " * 30000)]
    got = {r.conv_id: r for r in chat.chat_table(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    turns += [(-7, 0, "user", odd[1]), (-7, 1, "assistant", odd[1])]
    for c in {t[0] for t in turns}:
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        text, spans = chat.render([(r, x) for _, r, x in own])
        assert chat.parse(text) == [(r, x) for _, r, x in own]
        _, ends = chat.encode(text)
        assert "".join(chat.unescape(chat.masked_text(text, ends, chat.mask(ends, spans), [s])) for s in spans) == loss
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(own), len(loss), len(text))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
    assert len(got) == len({t[0] for t in turns})


def test_mixing(spark, docs, none, rows):
    def targets(sizes):
        names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
        weight = {s: 1 + i % 3 for i, s in enumerate(names)}
        full, left, free = {}, float(sum(sizes.values())), set(names)
        while True:
            level = left / sum(weight[s] for s in free)
            over = [s for s in free if weight[s] * level > 3 * sizes[s]]
            if not over:
                return {**full, **{s: weight[s] * level for s in free}}
            for s in over:
                full[s] = 3.0 * sizes[s]
                left -= full[s]
                free.discard(s)

    slim = with_row(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    got = slim.join(mixing.mix_plan(slim).drop("doc_id", "size"), "_row").collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORDS.findall(r[1] or ""))
    want = targets(size)
    assert len(got) == len(rows) and all(abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) <= sum(size.values())
    small = spark.createDataFrame([(1, "a", 10), (2, "b", 1000), (3, "c", 1000)], "doc_id long, source string, size long")
    assert [round(r.target) for r in mixing.source_targets(small).orderBy("source").collect()] == [30, 792, 1188]
    assert mixing.mixture(none).count() == 0 and mixing.mixture(docs).columns == docs.columns


def test_line_dedup(docs, none, rows):
    place = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = []
    for r in order:
        text = (r[1] or "").split("\n")
        solid = [i for i, x in enumerate(text) if WORDS.search(x)]
        gone = set()
        for k in range(len(solid)):
            for n in (1, 2, 3):
                run = solid[k : k + n]
                if len(run) == n and (n == 3 or sum(len(WORDS.findall(text[i])) for i in run) >= lines.RUN_WORDS):
                    body = "\n".join(text[i] for i in run)
                    if body in place:
                        gone.update(run)
                    place.setdefault(body, r[0])
                    break
        want.append((r[0], None if r[1] is None else "\n".join(x for i, x in enumerate(text) if i not in gone), len(gone)))
    assert by_row(lines.line_table(docs), "doc_id", "text", "n_deleted") == sorted(want, key=repr)
    assert lines.line_table(none).count() == 0 and sum(w[2] for w in want) > 50


def test_line_runs_are_extended_both_ways(spark, docs, rows):
    """Against every earlier place, line by line: a stretch of equal lines that holds a whole window goes."""
    def whole(run):
        return len(run) >= lines.RUN_LINES or sum(len(WORDS.findall(x)) for x in run) >= lines.RUN_WORDS

    def brute(table):
        solid = []
        for r in sorted(table, key=lambda r: (r[0] is None, r[0] or 0)):
            text = (r[1] or "").split("\n")
            solid.append((r, text, [i for i, x in enumerate(text) if WORDS.search(x)]))
        want = []
        for d, (r, text, own) in enumerate(solid):
            gone = set()
            mine = [text[i] for i in own]
            for e in range(d + 1):
                other = [solid[e][1][i] for i in solid[e][2]]
                for shift in range(1 - len(other), len(mine)):
                    if e == d and shift <= 0:
                        continue
                    k = max(0, shift)
                    while k < min(len(mine), len(other) + shift):
                        n = 0
                        while k + n < min(len(mine), len(other) + shift) and mine[k + n] == other[k + n - shift]:
                            n += 1
                        if n and whole(mine[k : k + n]):
                            gone.update(own[k : k + n])
                        k += n + 1
            want.append((r[0], None if r[1] is None else "\n".join(x for i, x in enumerate(text) if i not in gone), len(gone)))
        return sorted(want, key=repr)

    assert by_row(lines.line_table(docs, both_ways=True), "doc_id", "text", "n_deleted") == brute(rows)
    rnd = random.Random(4)
    kinds = ["a b", "c d e", "", "f " * 19, "g " * 21, "h " * 10, "i " * 10]
    small = [(i, "\n".join(rnd.choice(kinds) for _ in range(rnd.randint(1, 7)))) for i in range(60)]
    small += [(100, "long " * 25 + "\nshort end"), (101, "long " * 25 + "\nother end"), (102, "long " * 25 + "\nother end")]
    got = by_row(lines.line_table(spark.createDataFrame(small, "doc_id long, text string"), both_ways=True), "doc_id", "text", "n_deleted")
    assert got == brute(small) and (102, "", 2) in got and (101, "other end", 1) in got


def test_ngram_join(docs, none, rows):
    texts = {r[1] for r in rows if r[1] is not None}

    def grams(t):
        w = t.encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {t: grams(t) for t in texts}
    linked = {t: [o for o in texts if o != t and sets[t] and len(sets[t] & sets[o]) >= 0.8 * len(sets[t] | sets[o])] for t in texts}
    root = {t: t for t in texts}
    for _ in texts:
        root = {t: min([root[t], *(root[o] for o in linked[t])]) for t in texts}
    first = {}
    for r in rows:
        if r[1] is not None and r[0] is not None:
            first[root[r[1]]] = min(first.get(root[r[1]], 10**9), r[0])
    copies = Counter(r[1] for r in rows if r[1] is not None)
    want = [(r[0], None, 0, 1) if r[1] is None else (r[0], first[root[r[1]]], len(linked[r[1]]), copies[r[1]]) for r in rows]
    assert by_row(near.near_table(docs), "doc_id", "class_id", "n_links", "n_copies") == sorted(want, key=repr)
    keyed = docs.select("doc_id", "text", near.text_key(F.col("text")).alias("key"))
    texts_df = near.distinct_texts(keyed, *near.choose_bands())
    small = near.links(texts_df, keyed, block=2).groupBy("tid").agg(F.sum("links").alias("n")).agg(F.sum("n")).first()[0]
    assert small == sum(map(len, linked.values()))
    kept = near.one_per_class(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values())) + 2  # null texts stay
    assert near.near_table(none).count() == 0 and near.one_per_class(none).count() == 0


def test_bands_reach_their_recall():
    bands, per = near.choose_bands()
    assert bands * per <= near.HASHES and 1 - (1 - near.THRESHOLD**per) ** bands >= near.RECALL


def test_components_of_a_long_chain(spark):
    got = {r.id: r.root for r in components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_pipeline_on_awkward_tables(spark, docs, none, labels, benchmark, tmp_path):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    texts = {r.text for r in got.collect()}
    assert PASSAGE not in texts and got.columns == [*docs.columns, "shard", "slot"]
    assert len(corpus_pipeline.STAGES) == 5 and all(f(spark, none, str(tmp_path)).count() == 0 for _, f in corpus_pipeline.STAGES)


def test_toxicity_limit_parts_the_classes_and_chance_terms_stay_out(spark):
    import numpy as np

    assert toxicity._best_limit(np.array([0.0, 1.0, 3.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0])) == 2.0
    assert toxicity._best_limit(np.array([1.0, 1.0]), np.array([0.0, 1.0])) == 2.0
    seen = [(1, 20, 0), (2, 5, 3), (3, 0, 9)]  # a sure term, one by chance, a clean one
    df = spark.createDataFrame(seen, "term int, bad long, good long").withColumn("e", toxicity._evidence(0.115))
    assert [r.e >= toxicity.LEAST_EVIDENCE for r in df.orderBy("term").collect()][:2] == [True, False]


def test_ids_are_those_of_a_freshly_loaded_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    rnd = random.Random(9)
    signs = ["a", "Éß", "'s", "'ll", " ", "  ", "\n", "\t", "42", ".", "!?", "<|endoftext|>", "<|endof", "text|>", "日本", "é", "🙂", " word", "İ", "\x00", "x" * 70]
    texts = ["a  <|endoftext|>", "<|endoftext|>", " <|endoftext|> <|endoftext|>b", "end <|endoftext|>.", "", "it's l'été, don't-won't"]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 25))) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(token_files.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def foreign_record(kind, page, body):
    raw = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{page}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    return gzip.compress(raw)


@pytest.mark.parametrize("kind", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_archives_of_other_writers_are_read_by_their_index(spark, tmp_path, kind):
    """Two stored WARC files and CDXJ indexes, as other tools package them."""
    files, lines = {"one.warc.gz": b"", "two.warc.gz": b""}, []
    for i in range(7):
        name, made = list(files)[i % 2], foreign_record("warcinfo" if i == 0 else "response", f"page-{i}", f"body {i}".encode() * (i + 1))
        told = {"url": f"http://x/{i}", "filename": name, "offset": str(len(files[name])), "length": str(len(made))}
        lines.append(f"com,x)/{i} 2024010100000{i} {json.dumps(told)}")
        files[name] += made
    path = tmp_path / "foreign.wacz"
    with zipfile.ZipFile(path, "w") as z:
        for name, raw in files.items():
            z.writestr(f"archive/{name}", raw)
        z.writestr("indexes/index.cdxj", "!meta 0 {}\n" + "\n".join(lines[:4]) + "\n", kind)
        z.writestr("indexes/more.cdx.gz", gzip.compress(("\n".join(lines[4:]) + "\n").encode()))
        z.writestr("pages/pages.jsonl", "{}", kind)
    archive = spark.createDataFrame([(f"file://{path}",)], "archive string")
    got = archives.read_records(archives.locate(archive)).collect()
    assert sorted(r.record_type for r in got) == ["response"] * 6 + ["warcinfo"] and all(r.page_id is None for r in got)
    assert sorted(bytes(r.payload) for r in got if r.payload is not None) == [f"body {i}".encode() * (i + 1) for i in range(1, 7)]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/one.warc.gz", files["one.warc.gz"], zipfile.ZIP_DEFLATED)
        z.writestr("indexes/index.cdxj", lines[0])
    with pytest.raises(Exception, match="not stored"):
        archives.locate(archive).collect()


def test_archives_are_read_by_as_many_tasks_as_their_bytes_ask_for(spark, monkeypatch):
    rnd = random.Random(1)
    pages = spark.createDataFrame([(i, f"u{i}", "".join(rnd.choice("abcdefgh ") for _ in range(4000))) for i in range(60)], "page_id long, url string, html string")
    folder = "file://" + archives.fresh_path(spark, "read").removeprefix("file:")
    places = archives.locate(archives.write_archives(pages, folder))
    monkeypatch.setattr(archives, "READ_BYTES", 10_000)
    got = archives.read_records(places)
    size = places.agg(F.sum("length")).first()[0]
    assert got.rdd.getNumPartitions() == -(-size // 10_000) > 5 and got.count() == 60


def test_proximity(spark):
    docs = [(1, "alpha x x beta"), (2, "alpha x x x x x x beta"), (3, "Beta, ALPHA! alpha"), (4, None), (5, ""), (3, "Beta, ALPHA! alpha"), (None, "beta alpha"), (6, "gamma")]
    items = [(10, "alpha beta"), (11, "beta gamma"), (12, None), (13, " ,"), (14, "gamma gamma")]
    df = spark.createDataFrame([(*r, "b") for r in docs], "doc_id long, text string, block string").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, chunk int")
    near = lambda t, terms, slop: [i for i, w in enumerate(t) if w == terms[0] and all(any(abs(i - j) <= slop for j, x in enumerate(t) if x == o) for o in terms)]
    words = lambda t: re.findall(r"[a-z]+", (t or "").lower())
    total = Counter(w for _, t in docs for w in words(t))
    want = []
    for d, t in docs:
        found = {i: near(words(t), sorted(set(words(q)), key=lambda w: (total[w], w)), 4) for i, q in items if words(q)}
        if any(found.values()):
            want.append((d, len({p for ps in found.values() for p in ps}), sum(bool(ps) for ps in found.values())))
    assert by_row(decontam.proximity_table(df, bench, 4), "doc_id", "n_near", "n_items") == sorted(want, key=repr) and len(want) == 5
    assert decontam.proximity_table(df, bench.limit(0)).count() == decontam.proximity_table(df.limit(0), bench).count() == 0


def test_the_benchmark_stays_a_table(docs, benchmark):
    index = decontam.build_index(docs, ["doc_id"], block_words=50)
    whole = by_row(decontam.matches(index, benchmark), "block", "item", "first", "last")
    assert by_row(decontam.matches(index, benchmark, item_bytes=1), "block", "item", "first", "last") == whole and whole
    plan = decontam.matches(index, benchmark, item_bytes=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") <= 1 and "LocalRelation" not in plan  # one branch, however many chunks
