"""Licence texts, notices in long lines and bent terms, over all of their input."""

from factspan.llm import licenses, toxicity


def test_whole_texts_of_common_licenses(spark):
    files = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    bsd = files.pop("BSD-3-Clause-UC")
    ours = bsd.replace("University", "copyright holder").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
    short = files["Apache-2.0"].split("APPENDIX")[0]
    rows = [*files.items(), ("BSD-3-Clause", bsd), ("BSD-3-Clause", ours), ("Apache-2.0", short), (None, short + "more")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert len(files) == 13 and [r["license"] for r in licenses.with_license(df).where("doc_id is distinct from license").collect()] == []


def test_notices_in_long_lines(spark):
    banner = f"/{'*' * 300} Licensed under the MIT License. {'*' * 300}/"
    df = spark.createDataFrame([(1, f"code\n{banner}\n{' ' * 500}All rights reserved.\nmore"), (2, banner + " not")], "doc_id bigint, text string")
    got = [(r["doc_id"], r["n_notices"], r["notices"]) for r in licenses.license_report(df).orderBy("doc_id").collect()]
    assert got == [(1, 2, "MIT,proprietary"), (2, 0, "")]


def test_every_term_is_bent():
    terms = [("scum", False), ("réeux", False), ("vequil", True), ("漢字語彙", False), ("𠀀𠀁𠀂", True)]
    auto = toxicity.Automaton(terms, set(range(5)))
    words = ["scum", "scuum", "scm", "réoux", "vequilant", "vaquilant", "vqu", "漢字語彙", "漢字語", "𠀀𠀁𠀂𠀃", "𠀀𠀂x", "plain"]
    got = auto.run(toxicity.Points(["。".join(words)])).tolist()
    assert got == [0, 5, 5, 6, 2, 7, -1, 3, 8, 4, 9, -1]
    near = toxicity.near_terms(terms)
    assert [min(near(w), default=-6) + 5 for w in words if w not in ("scum", "vequilant", "漢字語彙", "𠀀𠀁𠀂𠀃")] == [5, 5, 6, 7, -1, 8, 9, -1]


def test_model_bends_stems_and_short_terms():
    fill = "alpha beta gamma delta epsilon zeta eta theta ".split()
    rows = [(" ".join(fill[(i + k) % 8] + str(i % 7) for k in range(12)) + (" scum vequil" + "abcd"[i % 4] * 3 + " 漢字語彙" if i % 2 else ""), i % 2) for i in range(400)]
    model = toxicity.Model([t for t, _ in rows], [y for _, y in rows])
    plain = "alpha1 beta1 gamma1 "
    clean, *bent = model.score([plain, plain + "scuum", plain + "vequxlaaa", plain + "漢字語彚", plain + "漢字語彙。"])
    assert all(x > clean for x in bent)
