from pyspark.sql import functions as F

from factspan.operators import extraction, pages, pointers


def test_lines_of_glyphs(spark):
    rows = [(1, 100.0, 0.0, 5.0, "A"), (1, 99.0, 5.1, 9.0, "b"), (1, 101.5, 14.0, 18.0, "C"), (1, 90.0, 0.0, 4.0, "D")]
    got = pages.glyph_lines(spark.createDataFrame(rows, "page_id int, top double, lft double, rgt double, ch string")).orderBy(F.desc("y")).collect()
    assert [r["line"] for r in got] == ["Ab C", "D"]


def test_rows_and_periods(spark):
    lines = ["Surat Berharga Selain Saham ** 53,6 64,0 (49,8)", "tumbuh 9,7 8,1", "1 2 3 4", "Uraian Jan Feb Mar* 2026 Apr", "Jan Feb", "a 1,0 x 2 3 4"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    got = df.select(pages.line_row(F.col("x")).alias("r"), pages.line_periods(F.col("x")).alias("p")).orderBy("i").collect()
    assert [None if r["r"] is None else (r["r"]["label"], r["r"]["values"]) for r in got] == [("Surat Berharga Selain Saham **", [53.6, 64.0, -49.8]), None, None, None, None, ("a 1,0 x", [2.0, 3.0, 4.0])]
    assert [r["p"] for r in got] == [None, None, None, ["Jan", "Feb", "Mar*"], None, None]


def test_page_tables(spark):
    text = ["Kalimat biasa", "Tabel 1. Uang Beredar (triliun Rp)", "Uraian Jan Feb Mar", "M1 1,0 2,0 3,0", "M2 4,0 5,0 6,0", "Kuasi 1,0 2,0", "Lain 1 2 3", "lain 4 5 6", "Tabel 2. Kosong", "tidak ada"]
    lines = spark.createDataFrame([(7, float(100 - i), x) for i, x in enumerate(text)], "page_id int, y double, line string")
    got = {(r["label"], r["period"]): r["value"] for r in pages.page_tables(lines).collect()}
    assert got == {("M1", "Jan"): 1, ("M1", "Feb"): 2, ("M1", "Mar"): 3, ("M2", "Jan"): 4, ("M2", "Feb"): 5, ("M2", "Mar"): 6}
    assert pages.page_tables(lines).first()["unit"] == "triliun Rp"
    assert tuple(pages.answered_pages(lines).first()) == (7, 2, 1, False)
    kind = "page_id int, ord int, label string, `values` array<double>"
    rows = spark.createDataFrame([(7, 0, "M1", [1.0, 2.5]), (7, 1, "x", [1.0])], kind)
    printed = spark.createDataFrame([(7, 4, "M1", [1.0, 2.0])], kind)
    align = spark.createDataFrame([(7, 0, 4)], "page_id int, a_ord int, b_ord int")
    assert [r["values"] for r in pages.verify_rows(rows, printed, align).orderBy("ord").collect()] == [[1.0, 2.0], None]


def test_pointers(spark):
    claims = spark.createDataFrame(
        [("a", "yoy_growth", [(0, "Penjualan eceran", 2026, "Jan", None)]), ("b", "value", [(0, "Harga", 2026, "Jan", None), (1, "Harga", None, None, "Stok")]), ("c", "value", [(0, "Inflasi", 2026, "Jan", None)])],
        "claim_id string, operation string, points array<struct<ord:int,metric_label:string,year:int,period:string,col_label:string>>",
    )
    q = pointers.point_queries(claims)
    assert sorted((r["claim_id"], r["year"], r["prior"]) for r in q.collect()) == [("a", 2025, True), ("a", 2026, False), ("c", 2026, False)]
    cells = spark.createDataFrame([("s", 0, 0, "text", "Indeks eceran", None), ("s", 0, 1, "num", None, 5.0), ("s", 0, 2, "num", None, 4.0), ("s", 1, 1, "num", None, 9.0)], "source_id string, r int, c int, kind string, s_val string, d_val double")
    titles = spark.createDataFrame([("s", "Survei")], "source_id string, title string")
    assert {r["claim_id"] for r in pointers.could_match(q.withColumn("source_id", F.lit("s")), cells, titles).collect()} == {"a"}
    found = spark.createDataFrame([("a", 0, False, "s", 0, 0, 1), ("a", 0, True, "s", 0, 0, 2), ("c", 0, False, "s", 0, 0, 1)], "claim_id string, ord int, prior boolean, source_id string, source_ord int, r int, c int")
    got = pointers.settle(found, q, cells, titles).collect()
    assert [(r["claim_id"], [x["value"] for x in r["found"]]) for r in got] == [("a", [5.0, 4.0])]
    results = spark.createDataFrame([(0, "Kredit UMKM", "Inconclusive", None), (1, "DPK", "Inconclusive", "x"), (2, "Uang primer kredit", "Inconclusive", None), (3, "Kredit", "Refuted", None)], "claim_ord int, metric_label string, verdict string, matched_source string")
    families = spark.createDataFrame([(0, "M0", "uang primer"), (1, "Loans", "kredit"), (1, "Loans", "kmk")], "family_ord int, family string, keyword string")
    assert {r["family"]: r["metrics"] for r in pointers.suggest_tables(results, families).collect()} == {"M0": ["Uang primer kredit"], "Loans": ["Kredit UMKM"]}


def test_finalize(spark):
    p = "claim_id string, operation string, value_raw string, unit string, quote string, points array<struct<metric_label:string,year:int,month:string,col_label:string>>"
    rows = [("a", "value", "9,7", "persen", "q", [("M2", 2026, "April", "x")]), ("b", "value", "abc", None, "q", [("M2", 2026, "Apr", None)]), ("c", "is_stable", "5", None, "q", [("M2", None, None, " Stok ")]), ("d", "value", "1", None, "q", [("M2", 2026, "foo", None)])]
    got = {r["claim_id"]: r for r in extraction.finalize(spark.createDataFrame(rows, p)).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"]["claimed_value"] == 9.7 and tuple(got["a"]["points"][0]) == (0, "M2", 2026, "Apr", None)
    assert got["c"]["claimed_value"] is None and got["c"]["points"][0]["col_label"] == "Stok"


def test_locate(spark):
    text = "Survei dimuat. Indeks IKK berada pada level optimis 120,5 poin. Indeks IEK berada pada level optimis 130. Selesai"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = [("a", 1, "berada pada level optimis", "Indeks IEK", "130"), ("b", 1, "berada pada level optimis", "IKK", "120,5"), ("c", 1, "tidak pernah ada di sini sama sekali", "x", None), ("d", 1, "kata lain Indeks IKK berada pada level optimis sekali", "IKK", None)]
    got = {r["claim_id"]: r["sentence"] for r in extraction.locate(spark.createDataFrame(rows, "claim_id string, doc_id int, anchor string, metric string, value_raw string"), docs).collect()}
    assert got == {"a": "Indeks IEK berada pada level optimis 130.", "b": "Indeks IKK berada pada level optimis 120,5 poin.", "d": "Indeks IKK berada pada level optimis 120,5 poin."}
