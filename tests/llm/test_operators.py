"""Every operator against a brute-force version on small texts, and on rows that could break it."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factspan.llm import bpe, decontaminate, embeddings, langid, licenses, linededup, minhash, suffixes, tokencount, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(25)]
    near = []
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    odd = [None, "", "   ", "one", "Éä 漢字 ñ", "x" * 30_000, "a b\nc d\n" * 50, "  two words ", base[0], base[0], base[1].upper()]
    return base + near + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"k{i}", f"h{i}", f"s{i}") for i, t in enumerate(texts)] + [(None, "a null id", "en", "k", "h", "s"), (3, texts[3], "en", "k", "h", "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key string, hits string, score string").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# 1


@pytest.mark.parametrize("block", [500_000, 3])
def test_decontamination(spark, docs, texts, block):
    rng = random.Random(9)
    items = [(1, " ".join(texts[2].split()[:14])), (2, "one"), (3, None), (4, ""), (None, texts[5]), (5, prose(rng, 30)), (2, "a null ID"), (10, texts[1].upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontamination_report(docs, bench, block=block).collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update(() if i is None else (str(i),))
    expected = []
    for r in docs.select("doc_id", "text").collect():
        w, hit, ids = split(r["text"]), set(), set()
        for g, names in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    ids |= names
        expected.append((r["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert Counter(map(tuple, got)) == Counter(expected)
    assert sum(e[-1] for e in expected) >= 3


def test_decontamination_modes(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.where("text = 'one'").count() == 0
    cut = decontaminate.decontaminate(spark.createDataFrame([(1, "say One twice"), (2, None)], "doc_id bigint, text string"), bench, mode="spans")
    assert {tuple(r) for r in cut.collect()} == {(1, "say  twice"), (2, None)}
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == docs.count()


# 2


@pytest.mark.parametrize("cell, block", [(4000, 3000), (10, 7)])
def test_embeddings(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((70, 8))
    x[30:60] = x[:30] + 0.2 * rng.standard_normal((30, 8))
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 2) for i in range(70)]
    rows += [(70, rows[0][1], 0), (71, rows[0][1], 1), (72, None, 0), (73, [0.0] * 8, 0), (74, [float("nan")] + [1.0] * 7, 0), (75, [None] + [1.0] * 7, 0), (76, rows[0][1], None), (77, [], 0), (78, [1.0], 0), (79, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.vector_links(df).collect()}
    good = {i: (np.array(v), la) for i, v, la in rows if v and la is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, (v, la) in good.items() for b, (w, lb) in good.items() if a < b and la == lb and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
    comp = components([r[0] for r in rows], links)
    degree = Counter(x for ab in links for x in ab)
    assert got == {i: (degree[i], comp[i], comp[i] == i) for i, _, _ in rows}
    assert len(links) > 10
    assert embeddings.vector_links(df.where("false")).count() == 0


def test_embeddings_extremes(spark):
    rows = [(0, [1e200, 1e200], 1), (1, [1e200, 1.01e200], 1), (2, [1e-200, 1e-200], 2), (3, [0.9, 0.1], 2), (4, [1e-200, 1.01e-200], 2), (5, [5e-324, 5e-324], 3), (6, [1.0, 1.0], 3), (6, [1.0, -1.0], 3), (None, [2.0, 2.0], 3)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, label int, node string, vector string")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.vector_links(df).collect())
    assert got == Counter([(0, 1, 0, True), (1, 1, 0, False), (2, 1, 2, True), (4, 1, 2, False), (3, 0, 3, True), (5, 2, 5, True), (6, 2, 5, False), (6, 0, 6, True), (None, 2, 5, False)])


# 3


def test_network_is_its_definition():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"], seed=3)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (1, 3, 255, 256, 257, 1000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got, p = net.predict(data, np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        logits = []
        for at in range(0, len(t), langid.WINDOW):
            x = t[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            best = [max(sum(float(tables[k][x[j + k], f]) for k in range(w)) for j in range(langid.WINDOW - w + 1)) for w, tables in zip(langid.WIDTHS, net.tables, strict=True) for f in range(langid.FILTERS)]
            logits.append(np.tanh(best) @ net.out + net.bias)
        z = np.mean(logits, 0)
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i] == q.argmax() and abs(p[i] - q.max()) < 1e-4


def test_language_odd_rows(spark):
    rows = [(i % 90, "the and of in that " * (i % 7 + 1) if i % 30 else "el la que los " * 9, "en" if i % 30 else "es") for i in range(180)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.fit(df, sample=10)
    assert net.languages == ["en", "es"]
    odd = spark.createDataFrame([(1, "the and of " * 40_000, 5, "x"), (2, None, 6, "y"), (2, None, 6, "y")], "doc_id bigint, text string, score int, lang_pred string")
    got = langid.identify(odd, net)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and Counter(r["lang_pred"] for r in got.collect()) == {"en": 1, "und": 2}
    with pytest.raises(ValueError):
        langid.identify(odd, net, score="text")


def test_language(spark, docs, nothing):
    rng = random.Random(1)
    sample = {"xx": "the and of in that with for", "yy": "der und die das mit für ß", "zz": "el la que los ñ por ción"}
    rows = [(i, " ".join(rng.choice(sample[la].split()) for _ in range(rng.randint(5, 200))), la) for i in range(300) for la in [rng.choice(list(sample))]]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "123 !!", "xx"), (903, "the and of", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.language_report(df).collect()}
    held = [i for i, _, _ in rows[:300] if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert langid.language_report(df.where("lang is null")).first()["lang_pred"] == "und"
    assert langid.language_report(df.where("false")).count() == 0


# 4


@pytest.mark.parametrize("posting, shingles", [(4096, 2_000_000), (2, 40)])
def test_minhash(docs, nothing, texts, monkeypatch, posting, shingles):
    monkeypatch.setattr(minhash, "POSTING_BLOCK", posting)
    monkeypatch.setattr(minhash, "SHINGLE_BLOCK", shingles)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.minhash_report(docs.where("doc_id is not null"), shingle=4).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(sets, links)
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert len(links) >= 8


def test_collisions_are_counted():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 4, (60, minhash.COORDINATES)).astype(np.uint32)
    sig[20:40, :40] = sig[:20, :40]
    lists = minhash.Postings(sig)
    for i in range(len(sig)):
        dense = (sig == sig[i]).sum(1)
        got = lists.collisions(i, minhash.MATCHES)
        assert ((got >= minhash.MATCHES) == (dense >= minhash.MATCHES)).all()
        assert (got[dense >= minhash.MATCHES] == dense[dense >= minhash.MATCHES]).all()


def test_minhash_drop(docs, nothing):
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 3").count() == 2
    assert minhash.drop_near_duplicates(nothing).count() == 0


# 5


def test_token_counts(docs, nothing):
    pieces = tokencount.Pieces()

    def brute(word):
        w = tokencount.START + word
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            found = [(best[e - 1][0] + pieces.unknown, best[e - 1][1] - len(w[e - 1].encode()))]
            found += [(best[e - n][0] + pieces.score[w[e - n : e]], best[e - n][1] - 1) for n in range(1, min(pieces.longest, e) + 1) if w[e - n : e] in pieces.score]
            best.append(max(found))
        return -best[-1][1]

    some = docs.where("length(text) < 5000 or text is null")
    got = Counter(map(tuple, tokencount.token_report(some).collect()))
    want = Counter((r["doc_id"], len((r["text"] or "").split()), sum(map(brute, (r["text"] or "").split()))) for r in some.collect())
    assert got == want
    assert tokencount.token_report(nothing).count() == 0


def test_token_counts_odd_rows(spark):
    rows = [(1, "漢字かな" * 400 + " ab", "x"), (2, "x" * 5_000, "y"), (2, "x" * 5_000, "y"), (3, None, None)]
    got = tokencount.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string"))
    counts = [r["n_tokens"] for r in got.orderBy("doc_id").collect()]
    assert got.columns == ["doc_id", "text", "n_tokens"] and counts[1] == counts[2] > 0 and counts[3] == 0 and counts[0] > 400


def test_token_counts_ties():
    pieces = tokencount.Pieces(pieces={"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁ab": -3.0})
    assert tokencount.count_words(pieces, ["ab", "a", "q", "aé"]).tolist() == [1, 2, 2, 4]


# 6


def test_line_dedup(spark, docs, nothing):
    rng = random.Random(8)
    lines = [prose(rng, rng.randint(1, 60)) for _ in range(20)]
    near = [" ".join([*t.split()[:-1], "end"]) for t in lines]
    rows = [(i, "\n".join(rng.choice([*lines, *near, "", "  ", "Short", "short"]) for _ in range(rng.randint(1, 8)))) for i in range(40)]
    rows += [(40, None), (41, ""), (None, lines[0]), (42, rows[0][1]), (42, rows[0][1]), (43, lines[1].upper())]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, row string, dropped string").repartition(3)
    got = Counter(map(tuple, linededup.line_report(df).collect()))
    every = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            w = line.lower().split()
            s = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} or ({tuple(w)} if w else set())
            every.append(((i is not None, i or 0), k, s))
    want = []
    for i, t in rows:
        me = (i is not None, i or 0)
        gone = sorted({k for d, k, s in every if d == me and s and any((e, j) < (d, k) and q and 100 * len(s & q) >= 80 * len(s | q) for e, j, q in every)})
        want.append((i, len(t.split("\n")) if t is not None else 0, len(gone), ",".join(map(str, gone))))
    assert got == Counter(want)
    out = linededup.drop_repeated_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert linededup.drop_repeated_lines(nothing).count() == 0


def test_line_dedup_compares_words(spark):
    assert spark.sql("select hash('w254943') = hash('w267111')").first()[0]
    rows = [(1, "w254943"), (2, "w267111"), (3, "a b c d e f w254943"), (4, "a b c d e f w267111"), (5, "w254943\n" + "z" * 60_000), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [(r["doc_id"], r["removed"]) for r in linededup.line_report(df).orderBy("doc_id").collect()] == [(None, ""), (1, ""), (2, ""), (3, ""), (4, ""), (5, "0")]
    odd = spark.createDataFrame([(1, "a b"), (2, "a b\n a  b"), (3, ""), (4, None), (5, " ")], "doc_id bigint, text string")
    assert [tuple(r) for r in linededup.drop_repeated_lines(odd, emptied=False).orderBy("doc_id").collect()] == [(1, "a b"), (3, ""), (4, None), (5, " ")]


def test_line_dedup_splits_once(spark, docs):
    """Each line is split and hashed once, and each pair intersected once; the rule is the fraction's."""
    plan = linededup._lines(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") == 1 and plan.count("size(split(") == 0, plan
    x, y = F.col("x"), F.col("y")
    assert str(linededup._enough(x, y, 80)).count("array_intersect") == 1
    sets = [(list(range(a)), list(range(s)) + list(range(100, 100 + b - s))) for a in range(1, 12) for b in range(1, 12) for s in range(min(a, b) + 1)]
    for r in spark.createDataFrame(sets, "x array<int>, y array<int>").withColumn("fits", linededup._enough(x, y, 80)).collect():
        assert r["fits"] == (100 * len({*r["x"]} & {*r["y"]}) >= 80 * len({*r["x"], *r["y"]}))


def test_line_dedup_writes_little(spark, docs, monkeypatch):
    """Small shuffles end in few files, no table holds the words of all lines, and the session is left as it was."""
    key, seen = "spark.sql.adaptive.coalescePartitions.parallelismFirst", []
    before, write = spark.conf.get(key), linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, tag: seen.append((tag, spark.conf.get(key), "words" in df.columns)) or write(df, tag))
    linededup.line_report(docs).count()
    assert seen and all(held == "false" and not words for _, held, words in seen), seen
    assert spark.conf.get(key) == before


def test_line_dedup_same_hash(spark, monkeypatch):
    """Lines of other words with one hash are told apart with another hash."""
    df = spark.createDataFrame([(1, "a b\nc d e f g h"), (2, "c d e f g h\nx y"), (3, "a  b"), (4, None)], "doc_id bigint, text string")
    tidied, salts = linededup._tidied, []
    monkeypatch.setattr(linededup, "_tidied", lambda docs, doc_id, text, salt=0: salts.append(salt) or tidied(docs, doc_id, text, salt).withColumn("k", F.when(F.lit(salt == 0), F.lit(7).cast("long")).otherwise(F.col("k"))))
    assert [(r["doc_id"], r["removed"]) for r in linededup.line_report(df).orderBy("doc_id").collect()] == [(1, ""), (2, "0"), (3, "0"), (4, "")]
    assert sorted({*salts}) == [0, 1]


def test_line_dedup_few_grams(spark):
    """Lines post about half as many grams as their prefixes have shingles, repetitive ones each gram once, and no similar pair is lost."""
    rng = random.Random(5)
    plain = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(36)) for _ in range(200)]
    lines = spark.createDataFrame([(t, i) for i, t in enumerate([*plain, "a b " * 500 + "c", "a b c d"])], "line string, k bigint")
    posts = Counter(r["k"] for r in linededup._posts(linededup._ranked(lines, "k"), 5, 80).where("token is not null").collect())
    assert sum(posts[i] for i in range(200)) <= 200 * 5 and posts[200] == 3 and 201 not in posts, posts

    def bent(w):  # a few words changed, moved, stuttered or cut
        w, at = [*w], rng.randrange(len(w))
        kind, size = rng.randrange(5), rng.randint(1, 1 + len(w) // 8)
        if kind == 0:
            w[at] = rng.choice(w)
        elif kind == 1:
            w = w[at:] + w[:at]
        elif kind == 2:
            w = w[:at] + w[max(0, at - size) : at] + w[at:]
        else:
            w = w[size:] if kind == 3 else w[:-size]
        return w or ["x"]

    rows = []
    for words in (2, 4, 12, 400):
        for _ in range(12):
            base = [f"word{rng.randrange(words)}" * rng.randint(1, 2) for _ in range(rng.choice([5, 6, 9, 14, 30, 60, 120, 200]))]
            base = (base[: rng.randint(1, 12)] * len(base))[: len(base)] if rng.random() < 0.3 else base
            rows += [(len(rows) + j, " ".join(w)) for j, w in enumerate([base, *[bent(base) for _ in range(5)], bent(bent(base))])]
    sets = [({tuple(w[a : a + 5]) for a in range(len(w) - 4)} or {tuple(w)}) for w in (t.split() for _, t in rows)]
    gone = [i for i, s in enumerate(sets) if any(100 * len(s & q) >= 80 * len(s | q) for q in sets[:i])]
    got = linededup.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).where("n_removed = 1").collect()
    assert len(gone) > 60 and sorted(r["doc_id"] for r in got) == gone


def test_line_dedup_is_native(docs):
    plan = linededup.line_report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 7


def test_bpe(docs, nothing):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    tok = Tokenizer.from_file(bpe.default_path())
    letters = "aaabcdefghinorst  '' ''s't.,!?-_0123éèñüßΣσςİı中文 日本\t\n\u0085 \x1c\x00<|>😀👩‍👩‍👧éÅ½²عربي"
    extra = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["<|endoftext|>a<|startoftext|>", "I'LL they'Re 'S", "a" * 3000]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(list(enumerate(extra, 1000)), "doc_id bigint, text string"))

    def want(r):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(tok.decode(ids, skip_special_tokens=False))

    rows = df.collect()
    assert Counter(map(tuple, bpe.bpe_report(df).collect())) == Counter(map(want, rows))
    coded = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.decode(bpe.encode(df.where("doc_id >= 1000"))).collect()}
    same = {r["doc_id"]: (r["ids"], r["back"]) for r in bpe.encode(df.where("doc_id >= 1000"), decoded="back").collect()}
    assert same == coded
    for i, t in enumerate(extra, 1000):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert coded[i] == (ids, tok.decode(ids, skip_special_tokens=False))
    assert bpe.bpe_report(nothing).count() == 0


# 8


def test_licenses(spark, nothing):
    mit = licenses.LICENSES["MIT"].replace("Copyright (c)", "Copyright (c) 2020 Somebody\n(c) Others").replace("merge", "MERGE").replace("sublicense", "sub-license")
    rows = [(1, mit), (2, "Some text.\nReleased under the MIT Licence\nall rights reserved"), (3, None), (4, ""), (5, mit + " more"), (1, mit)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["license"], r["n_notices"], r["notices"]) for r in licenses.license_report(df).orderBy("doc_id").collect()]
    assert got == [(1, "MIT", 0, ""), (1, "MIT", 0, ""), (2, None, 2, "MIT,proprietary"), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, "")]
    assert licenses.license_report(nothing).count() == 0
    assert licenses.with_license(df.withColumnRenamed("doc_id", "digest")).where("license = 'MIT'").count() == 2


def test_license_texts(spark):
    known = licenses.whole_texts()
    frame = "/" * 900 + "  Licensed under the MIT License.  " + "*" * 900
    rows = [(i, "Copyright 2001 Somebody\n" + t.upper().replace("\n", "  \n"), "x") for i, (_, t) in enumerate(known)] + [(900, frame, "x"), (901, frame + "\n" + "long " * 50_000, "x")]
    got = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string, digest string")).collect()}
    names = {got[i]["license"] for i in range(len(known))}
    assert {"MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0"} <= names and None not in names
    assert all(got[i]["license"].removesuffix("-untitled") == name.removesuffix("-untitled") for i, (name, _) in enumerate(known))
    assert [(got[i]["n_notices"], got[i]["notices"]) for i in (900, 901)] == [(1, "MIT")] * 2


# 9


@pytest.mark.parametrize("together", [20_000, 1])
def test_suffixes(spark, docs, nothing, monkeypatch, together):
    monkeypatch.setattr(suffixes, "SORTED_TOGETHER", together)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 900))) for _ in range(12)]
    texts = list(base)
    for _ in range(20):
        x, y = rng.choice(base), rng.choice(base)
        a = rng.randint(0, len(x))
        texts.append(y[: rng.randint(0, 300)] + x[a : a + rng.randint(150, 420)] + y[-rng.randint(0, 100) :])
    texts += ["ab" * 400, "a" * 1000, "Ther " * 300, None, "", "x" * 199, "y" * 200, "y" * 200, "z" * 201, base[3]]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, key string").repartition(3)
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    want = {}
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeat_report(df).collect()} == want
    cut = suffixes.remove_repeats(df)
    assert cut.columns == df.columns and cut.where("text is null").count() == 1
    assert suffixes.repeat_report(nothing).count() == 0


def test_suffix_sort():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    data[300:520] = data[20:240]
    start = rng.permutation(500)
    order, shared = suffixes.suffix_sort(suffixes.PrefixHash(data), data, start, 200)
    got = [data[s : s + 200].tobytes() for s in start[order]]
    assert got == sorted(got)
    for k in range(1, len(got)):
        same = next((i for i in range(200) if got[k][i] != got[k - 1][i]), 200)
        assert shared[k] == same


# 10


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    bad = ["scoundrel", "nitwit", "grobix", "groband"]
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, rng.randint(10, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) if i % 8 else rng.choice(["scoundrel", "gro" + "b" + rng.choice(["ent", "ula", "iss"])]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, labelled, nothing):
    rows, df, labels = labelled
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(df, labels).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert held and np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    model = toxicity.fit_labels(df, labels)
    plain = "alpha beta gamma delta " * 5
    clean, exact, typo, quoted, none, long = model.score([plain, plain + "you scoundrel scoundrel", plain + "you scoundrol scoundrels", plain + 'he said "scoundrel" again', None, plain * 3000])
    assert exact > 0.5 > clean and typo > clean and quoted < exact and abs(none - model.score([""])[0]) < 1e-12 and long < 0.5
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b")], "doc_id bigint, text string, score string")
    assert toxicity.drop_toxic(odd, model).count() == 3 and toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.toxicity_report(df, labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.toxicity_report(nothing.select("doc_id", "text"), labels).count() == 0


def test_toxicity_words():
    for text in ("坏人。你好，坏人", "Ünï-cøde ΣΑΣ İstanbul x²", "a_b 'c' “d”"):
        p = toxicity.Points([text])
        assert [p.word(k) for k in range(len(p.start))] == toxicity.words_of(text)


def test_toxicity_features(spark, labelled):
    """Hits, contexts and sums by plain loops over words."""
    model = toxicity.fit_labels(labelled[1], labelled[2])
    terms, n = model.automaton.terms, len(model.automaton.terms)
    rng = random.Random(7)
    marks = ["“{}”", '"{}"', "said {}", "called a {}", "{}", "{}\n"]
    for _ in range(40):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randint(0, len(words)), rng.choice(marks).format(rng.choice(["scoundrel", "scoundrol", "nitwit", "grobix", "alpha"])))
        text = " ".join(words)
        spans = [(m.start(), m.end()) for m in re.finditer("[a-z0-9]+", text)]
        total, most, kinds = 0.0, 0.0, set()
        for k, (a, b) in enumerate(spans):
            hit = int(model.automaton.run(toxicity.Points([text[a:b]]))[0])
            if hit < 0 or not model.weight[hit] > 0:
                continue
            left = text[max(0, spans[max(0, k - 8)][0] - 2) : a].split("\n")[-1]
            right = text[b : spans[min(len(spans) - 1, k + 8)][1] + 2].split("\n")[0]
            quoted = (left.count("“") > left.count("”") and "”" in right) or (left.count('"') % 2 and '"' in right)
            before = [text[c:d] for c, d in spans[max(0, k - 8, k - 3) : k]]
            w = model.weight[hit] * (toxicity.QUOTED if quoted else toxicity.REPORTED if set(before) & model.reporting else 1)
            total, most = total + w, max(most, w)
            kinds.add(hit)
        want = [np.log1p(total), most, np.log1p(len(kinds)), np.log1p(100 * total / max(1, len(spans)))]
        assert np.allclose(model.features([text])[0], want), text
        z = (np.array(want) - model.centre) / model.scale @ model.coef[:-1] + model.coef[-1]
        assert abs(model.score([text])[0] - 1 / (1 + np.exp(-z))) < 1e-9
    assert n == len(terms) and model.weight[:n].min() > 0


def test_toxicity_repeated_ids(spark, labelled):
    rows, df, labels = labelled
    again = df.unionByName(df).unionByName(df)
    one, three = toxicity.fit(df, labels, sample=30), toxicity.fit(again, labels.unionByName(labels), sample=30)
    assert one.automaton.terms == three.automaton.terms and np.allclose(one.coef, three.coef)


def test_automaton_is_edit_distance():
    terms = [("stupid", False), ("trash", False), ("vequ", True)]
    auto = toxicity.Automaton(terms, {0, 1})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(5)
    words = ["stupid", "trash", "vequil", "veq"]
    for _ in range(600):
        w = list(rng.choice(["stupid", "trash", "vequ"]))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "s", "1", "é"])
        words.append("".join(w) or "x")
    got = auto.run(toxicity.Points([" ".join(words)]))
    for w, t in zip(words, got.tolist(), strict=True):
        exact = next((k for k, (x, stem) in enumerate(terms) if not stem and x == w), None)
        near = [k for k in (0, 1) if edits(w, terms[k][0]) == 1]
        want = exact if exact is not None else 2 if w.startswith("vequ") else near[0] + 3 if near else -1
        assert t == want, w


def test_components(spark):
    from factspan.llm.tables import connected_components

    rng = random.Random(1)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
