import random
import re

import pytest
from pyspark.sql import functions as F

from factspan import queries
from factspan.operators import evaluation, markers, typos
from factspan.operators.text import STANDARD_FORMS

DICTIONARY = "kata buku makan dimakan tulis ditulis rumah jalan kejalan pada ini itu dan membaca terlihat mei satu".split()


def by_hand(text):
    """The pass word by word: certain issues, and places of candidates."""
    words = [(m.group(), m.start(), m.end()) for m in re.finditer("[A-Za-z]+(?:-[A-Za-z]+)*", text)]
    between = [text[a[2] : b[1]] for a, b in zip(words, words[1:])] + [None]
    sure, open_, k = set(), set(), 0
    while k < len(words):
        w, a, b = words[k]
        nxt = words[k + 1] if k + 1 < len(words) and between[k].isspace() else None
        if nxt and nxt[0] == w.lower() and w.isalpha() and len(w) > 2:
            sure.add((a, nxt[2], f"{w}-{nxt[0]}"))
            k += 1
        elif w.lower() in STANDARD_FORMS:
            sure.add((a, b, STANDARD_FORMS[w.lower()]))
        elif nxt and w.lower() in ("di", "ke") and (w + nxt[0]).lower() in DICTIONARY:
            open_.add(("prefix", nxt[0].lower(), a, nxt[2]))
            k += 1
        elif w == w.lower() and len(w) > 1 and (len(w) > 2 or set(w) & set("aiueo")) and w not in DICTIONARY:
            spans = [(i, j) for i in (k - 2, k - 1, k) for j in (k, k + 1, k + 2) if 0 < j - i < 3 and i >= 0 and j < len(words) and all(between[x] == " " for x in range(i, j))]
            made = {"".join(words[x][0] for x in range(i, j + 1)).lower() for i, j in spans}
            if not made & {*DICTIONARY, *typos.MONTHS}:
                open_.add(("word", w, a, b))
        k += 1
    return sure, open_


def test_pass_is_word_by_word(spark):
    rng = random.Random(5)
    bits = [*DICTIONARY, "di", "ke", "Di", "Rumah", "rumah", "resiko", "Analisa", "qwert", "xz", "ab", "m", "ei", "ta", "ngan", "te", "rli", "hat", "buku-buku", "KATA", "a"]
    gaps = [" ", " ", " ", " ", "  ", ", ", ". ", "\n", "; 12 "]
    texts = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    docs = markers.split_pages(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    words = spark.createDataFrame([(w,) for w in DICTIONARY], "word string")
    sure, cands = typos.issues_and_candidates(docs, words)
    got = {i: (set(), set()) for i in range(len(texts))}
    for r in sure.collect():
        got[r["doc_id"]][0].add((r["start"], r["stop"], r["suggestion"]))
    for r in cands.collect():
        got[r["doc_id"]][1].update((r["kind"], r["key"], o["start"], o["stop"]) for o in r["occurrences"])
        o = r["occurrences"][0]
        assert texts[r["doc_id"]][o["start"] : o["stop"]] in r["context"] and len(r["context"]) <= o["stop"] - o["start"] + 2 * typos.AROUND
    for i, t in enumerate(texts):
        assert got[i] == by_hand(t), t
    assert sum(len(b) for _, b in got.values()) > 100


def test_verdicts_hold_everywhere(spark):
    text = "[== Halaman 3 ==]\nqwert satu qwert. resiko\n\n[== Halaman 4 ==]\nitu qwert dan zxcv"
    docs = markers.split_pages(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    words = spark.createDataFrame([(w,) for w in DICTIONARY], "word string")
    told = spark.createDataFrame([(1, "word", "qwert", True, "ejaan", "papan", None), (1, "word", "zxcv", True, None, "x", "")], "doc_id int, kind string, key string, is_issue boolean, category string, suggestion string, explanation string")
    out = typos.report(docs, words, told)
    assert [(r["word"], r["category"], r["page"]) for r in out.orderBy("start").collect()] == [("qwert", "ejaan", 3), ("qwert", "ejaan", 3), ("resiko", "tidak_baku", 3), ("qwert", "ejaan", 4)]
    assert tuple(typos.counts(out).first()) == (1, 4, 3, 1, 0)
    assert typos.report(docs, words).count() == 1
    expected = spark.createDataFrame([(1, "QWERT", "ejaan"), (1, "lain  kata", "ejaan")], "case_id int, word string, category string")
    scores = evaluation.issue_scores(expected, out.withColumnRenamed("doc_id", "case_id")).first()
    assert (scores["tp"], scores["fp"], scores["fn"], scores["precision"], scores["recall"]) == (1, 1, 1, 0.5, 0.5)


def test_markers(spark):
    pages = spark.createDataFrame([(1, 2, "dua"), (1, 1, "satu"), (1, 3, " \n "), (2, 1, None)], "doc_id int, page int, text string")
    whole = markers.marked_text(pages)
    text = "[== Halaman 1 ==]\nsatu\n\n[== Halaman 2 ==]\ndua"
    assert [tuple(r) for r in whole.collect()] == [(1, text)]
    r = markers.split_pages(whole).first()
    assert r["text"] == "\nsatu\n\n\ndua" and [tuple(x) for x in r["ranges"]] == [(0, 7, 1), (7, 11, 2)]
    at = lambda o: whole.select(markers.page_before(F.col("text"), F.lit(o))).first()[0]
    assert [at(o) for o in (0, 20, text.index("dua"), 500)] == [None, 1, 2, 2]
    split = markers.split_pages(whole)
    assert [split.select(markers.page_in(F.col("ranges"), F.lit(o))).first()[0] for o in (0, 6, 7, 99)] == [1, 1, 2, 2]
    use = {r["doc_id"]: (r["n_pages"], r["layer"]) for r in markers.text_layer_use(pages.unionByName(spark.createDataFrame([(3, 1, "x" * 300)], pages.schema))).collect()}
    assert use == {1: (3, "transcribe"), 2: (1, "transcribe"), 3: (1, "text")}


@pytest.mark.parametrize(
    "text, want",
    [
        ("[== Halaman 1 ==]\na\n[== Halaman 2 ==]\nb", "[== Halaman 7 ==]\na\n[== Halaman 9 ==]\nb"),
        ("a only", "[== Halaman 7 ==]\na only\n[== Halaman 9 ==]"),
        (" ", "[== Halaman 7 ==]\n[== Halaman 9 ==]"),
    ],
)
def test_renumber(spark, text, want):
    df = spark.createDataFrame([(text, [7, 9])], "t string, p array<int>")
    assert df.select(markers.renumber(F.col("t"), F.col("p"))).first()[0] == want


def test_longest_chain():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in "ab"]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (x == y))
        got = evaluation.longest_chain([(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y])
        assert len(got) == best[-1][-1] and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert all(a[i] == b[j] for i, j in got)


@pytest.mark.parametrize("broadcast", [0, typos.BROADCAST])
def test_places_in_one_pass(spark, tmp_path, monkeypatch, broadcast):
    """Words of texts are not shuffled, only whole texts; a dictionary too large to broadcast gives the same places."""
    monkeypatch.setattr(typos, "BROADCAST", broadcast)
    texts = ["di makan ke makan ta ngan", "kata kata resiko qwert te rli hatKx é di makan", "", "ke  jalan di ke jalan"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join([*DICTIONARY, "kemakan"]))], "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.typo_issues(spark, str(tmp_path))
    got = sorted((r["doc_id"], r["start"], r["stop"], r["category"], r["suggestion"]) for r in out.collect())
    assert got == [
        (0, 0, 8, "prefix", "dimakan"), (0, 9, 17, "prefix", "dimakan"), (0, 18, 20, "word", None), (0, 21, 25, "word", None),
        (1, 0, 9, "grammar", "kata-kata"), (1, 10, 16, "tidak_baku", "risiko"), (1, 17, 22, "word", None), (1, 38, 40, "word", None),
        (3, 0, 9, "prefix", "kejalan"), (3, 10, 12, "word", None), (3, 13, 21, "prefix", "kejalan"),
    ]
    if broadcast:
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"Exchange hashpartitioning\(doc_id", final)) == 1, final
