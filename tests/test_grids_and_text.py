import io
import zipfile

import pytest
from pyspark.sql import functions as F

from factspan.operators import aggregates, evaluation, grid, text
from factspan.plans import hooks, readonly
from factspan.sources import tables, xlsx
from factspan.streaming import events

CELLS = "source_id string, r int, c int, kind string, s_val string, d_val double, ts_val timestamp_ntz"


def sheet(spark, rows, name="s"):
    out = []
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            if v is not None:
                text_ = isinstance(v, str)
                out.append((name, r, c, "text" if text_ else "num", v if text_ else None, None if text_ else float(v), None))
    return spark.createDataFrame(out, CELLS)


def test_single_header(spark):
    cells = sheet(spark, [["Inflasi"], ["(persen)"], [], ["Item", "Jan 2026", "Feb 2026", "Mar 2026"], ["Umum", 1, 2, 3], ["Inti", 4, None, 6], ["Umum", 9, 9, 9]])
    h = grid.header_rows(cells)
    assert h.first()["header_row"] == 3 and grid.label_columns(cells, h).first()["label_col"] == 0
    assert tuple(grid.titles(cells, h).first()) == ("s", "Inflasi", "persen")
    got = {(r["row_label"], r["year"], r["period"]): r["value"] for r in grid.single_header_facts(cells).collect()}
    assert got == {("Umum", 2026, "Jan"): 1, ("Umum", 2026, "Feb"): 2, ("Umum", 2026, "Mar"): 3, ("Inti", 2026, "Jan"): 4, ("Inti", 2026, "Mar"): 6}
    items = sheet(spark, [["Daftar"], ["Nama Barang", "Harga", "Stok"], ["Beras", 15, 3], ["Gula", 14, 2]])
    got = {(r["row_label"], r["col_label"]): r["value"] for r in grid.single_header_facts(items).collect()}
    assert got == {("Beras", "Harga"): 15, ("Beras", "Stok"): 3, ("Gula", "Harga"): 14, ("Gula", "Stok"): 2}


def test_two_row_header(spark):
    cells = sheet(spark, [["x", 2025, 2025, 2026, 2026], ["", "III", "IV", "I", "II"], ["a", 1, 2, 3, 4], ["y", 2025, 2026], ["", "Jan", "Jan"]])
    assert [r["year_row"] for r in grid.header_blocks(cells).collect()] == [0]
    runs = {r["r"]: (r["years"], r["merged"]) for r in grid.year_runs(cells).collect()}
    assert runs == {0: (4, True), 3: (2, False)}
    cols = grid.period_columns(cells).where("r = 0").orderBy("c").collect()
    assert [(r["year"], r["period"]) for r in cols] == [(2025, "Q3"), (2025, "Q4"), (2026, "Q1"), (2026, "Q2")]


def test_labels_of_grids(spark):
    rows = spark.createDataFrame([("s", 0, ["A.", "Indeks"]), ("s", 1, ["-", None]), ("s", 2, [None, "Kota"]), ("s", 3, ["Lain", None])], "source_id string, r int, parts array<string>")
    assert [r["row_label"] for r in grid.carry_labels(rows).orderBy("r").collect()] == ["Indeks", "Indeks", "Kota", "Lain"]
    rows = spark.createDataFrame([("s", 0, ["Bagian", None], False), ("s", 1, [None, "Isi"], True), ("s", 2, ["Data", "Isi"], True), ("s", 3, [None, "Dua"], True), ("t", 0, ["1.", "-"], True)], "source_id string, r int, parts array<string>, stored boolean")
    assert [(r["row_label"], r["short"]) for r in grid.carry_labels(rows).orderBy("source_id", "r").collect()] == [("Bagian", "Bagian"), ("Bagian > Isi", "Isi"), ("Data > Isi", "Data > Isi"), ("Data > Dua", "Data > Dua"), ("1. > -", "1. > -")]
    rows = spark.createDataFrame([("s", 0, "Giro", 0), ("s", 1, "Rupiah", 1), ("s", 2, "Tabungan", 0), ("s", 3, "Rupiah", 1)], "source_id string, r int, label string, indent int")
    assert [r["label"] for r in grid.qualify_by_parent(rows).orderBy("r").collect()] == ["Giro", "Giro > Rupiah", "Tabungan", "Tabungan > Rupiah"]
    rows = spark.createDataFrame([("s", "A > x", "x"), ("s", "A > y", "y"), ("s", "B > y", "y")], "source_id string, label string, short string")
    assert sorted(r["label"] for r in grid.drop_redundant_qualifiers(rows).collect()) == ["A > y", "B > y", "x"]
    rows = spark.createDataFrame([("s", "Giro (a)"), ("s", "giro A"), ("s", "Tabungan")], "source_id string, label string")
    assert [r["label"] for r in grid.drop_ambiguous_rows(rows).collect()] == ["Tabungan"]


def test_years(spark):
    cols = spark.createDataFrame([("s", c, p) for c, p in enumerate(["Nov", "Dec", "Jan", "Feb"])] + [("t", 0, "Jan"), ("t", 1, "Feb")], "source_id string, c int, period string")
    years = spark.createDataFrame([("s", 2025), ("s", 2026), ("t", 2025), ("t", 2026)], "source_id string, year int")
    assert [(r["c"], r["year"]) for r in grid.reconstruct_years(cols, years).orderBy("c").collect()] == [(0, 2025), (1, 2025), (2, 2026), (3, 2026)]
    anchors = spark.createDataFrame([("s", 0, 2025), ("s", 3, 2026)], "source_id string, c int, year int")
    assert [r["year"] for r in grid.sparse_year_columns(cols.where("source_id = 's'"), anchors).orderBy("c").collect()] == [2025, 2025, 2026, 2026]


def test_captions(spark):
    df = spark.createDataFrame([("Tabel 1. Kredit (triliun Rp)",), ("Tabel (2026)",), ("Tabel",)], "x string")
    assert [r[0] for r in df.select(grid.unit_from_caption(F.col("x"))).collect()] == ["triliun Rp", None, None]


def test_totals(spark):
    rows = [("s", lab, c, v) for lab, vs in {"a": (1, 2), "b": (3, 4), "Total": (4, 6.02)}.items() for c, v in zip("xy", vs, strict=True)] + [("t", "a", "x", 1.0), ("t", "b", "x", 1.0)]
    got = {(r["source_id"], r["row_label"]): r["is_sum"] for r in aggregates.sum_of_others(spark.createDataFrame([(a, b, c, float(v)) for a, b, c, v in rows], "source_id string, row_label string, col_label string, value double")).collect()}
    assert got == {("s", "a"): False, ("s", "b"): False, ("s", "Total"): True, ("t", "a"): False, ("t", "b"): False}


def test_tabular_lines(spark):
    lines = ["| a | b |", "Kredit    12,3", "Surat Berharga Selain Saham ** 53,6 64,0 (49,8)", "6,2 Mar 6,1 Apr 5,2 Mei 4,9 Jun", "M2 tumbuh 9,7% (yoy) pada Maret 2026", "", "  ", "Akhir."]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, line_no int, line string")
    assert [r["line"] for r in text.strip_tabular(df).orderBy("line_no").collect()] == ["M2 tumbuh 9,7% (yoy) pada Maret 2026", "", "Akhir."]


def test_narrative(spark):
    pages = {
        1: ["Uang beredar tumbuh lebih tinggi pada bulan ini karena kredit", "di beberapa kota.", "Judul Pendek", "* Angka sementara", "* M2 pada April 2026 tumbuh 9,7 persen dibanding tahun lalu"],
        2: ["Lampiran 1. Tabel uang beredar", "Kalimat ini cukup panjang tetapi ada di lampiran saja"],
        3: ["1 2 3 4 5 6", "1 2 3 4 5 6", "1 2 3 4 5 6", "Satu kalimat panjang di tengah tabel ini saja"],
    }
    df = spark.createDataFrame([(1, p, i, x) for p, xs in pages.items() for i, x in enumerate(xs)], "doc_id int, page int, line_no int, line string")
    assert [(r["page"], r["line_no"]) for r in text.narrative_lines(df).orderBy("page", "line_no").collect()] == [(1, 0), (1, 1), (1, 4)]


def test_chunks(spark):
    df = spark.createDataFrame([(1, p, "x" * n) for p, n in enumerate([40, 50, 20, 200, 10])], "doc_id int, page int, text string")
    assert [r["chunk"] for r in text.page_chunks(df, 100).orderBy("page").collect()] == [0, 0, 1, 2, 3]


def test_typos(spark):
    df = spark.createDataFrame([(1, "Rumah rumah rumah itu. RUMAH Rumah ijin k redit lz qwert di makan")], "doc_id int, text string")
    assert [(r["word"], r["suggestion"]) for r in text.reduplications(df).collect()] == [("Rumah rumah", "Rumah-rumah")]
    forms = spark.createDataFrame(list(text.STANDARD_FORMS.items()), "form string, suggestion string")
    assert [tuple(r) for r in text.nonstandard_words(df, forms).select("word", "suggestion").collect()] == [("ijin", "izin")]
    words = spark.createDataFrame([(w,) for w in "rumah itu ijin kredit di makan dimakan".split()], "word string")
    assert [r["word"] for r in text.unknown_words(df, words).collect()] == ["qwert"]
    assert [(r["display"], r["joined"]) for r in text.prefix_candidates(df, words).collect()] == [("di makan", "dimakan")]
    verdicts = spark.createDataFrame([("qwert", "typo", "query"), ("x", None, "y")], "word string, category string, suggestion string")
    assert text.apply_verdicts(text.unknown_words(df, words), verdicts).count() == 1


def test_evaluation(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "expected string, predicted string")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) for r in evaluation.class_metrics(pairs).collect()}
    assert got == {"a": (1, 0, 1, 1.0, 0.5), "b": (1, 2, 0, 0.333333, 1.0), "c": (0, 0, 1, 0.0, 0.0)}
    assert evaluation.overall_metrics(pairs).first()["accuracy"] == 0.5
    sides = "case_id int, {} string, operation string, metric string, periods array<string>, claimed_value double"
    labels = spark.createDataFrame([(1, "l1", "value", "Kredit", ["Jan"], 2.0), (1, "l2", "value", "Kredit", ["Jan"], 1.0), (1, "l3", "sum", "Kredit", ["Jan"], 1.0)], sides.format("claim_id"))
    results = spark.createDataFrame([(1, "r1", "value", "Kredit Bank", ["Jan", "Feb"], 1.0), (1, "r2", "value", "kredit", ["Jan"], 2.0)], sides.format("result_id"))
    assert {r["claim_id"]: r["result_id"] for r in evaluation.pair_off(labels, results).collect()} == {"l1": "r2", "l2": "r1", "l3": None}
    rows = spark.createDataFrame([(1, "a", i, x) for i, x in enumerate(["Uang Beredar", "Uang Kartal di Luar Bank", "Giro"])] + [(1, "b", i, x) for i, x in enumerate(["uang beredar", "Tabungan", "Uang Kartal di Luar"])], "page_id int, side string, ord int, label string")
    assert [(r["a_ord"], r["b_ord"]) for r in evaluation.sequence_pairs(rows).collect()] == [(0, 0), (1, 2)]


@pytest.mark.parametrize("sql", ["CREATE TABLE t AS SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "DROP TABLE t", "SELECT reflect('java.lang.System', 'exit', 0)", "SET x = 1", "SELECT java_method('a', 'b')", "CACHE TABLE t"])
def test_guard_refuses(spark, sql):
    with pytest.raises(readonly.NotReadOnly):
        readonly.check(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT 1 AS a", "WITH a AS (SELECT 1 AS x) SELECT x, count(*) FROM a GROUP BY x", "SELECT a.x FROM VALUES (1) AS a(x) JOIN VALUES (1) AS b(x) ON a.x = b.x ORDER BY 1 LIMIT 3", "SELECT sum(x) OVER (PARTITION BY x) FROM VALUES (1) AS a(x) UNION ALL SELECT 2"])
def test_guard_lets_queries_pass(spark, sql):
    assert readonly.run(spark, sql).count() >= 1


def test_hooks(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "claim string")
    got = hooks.ask(df, "claim", "answer", lambda xs: [x.upper() if x == "a" else None for x in xs]).collect()
    assert sorted(str(r["answer"]) for r in got) == ["A", "A", "None", "None"]
    assert hooks.ask(df, "claim", "answer", lambda xs: 1 / 0).where("answer is not null").count() == 0
    out = hooks.answer_queries(df.distinct(), lambda xs: [f"SELECT '{x}'" if x == "a" or "\n" in x else None for x in xs]).collect()
    assert sum(r["query"] is not None for r in out) == 2


def test_catalog(spark, tmp_path):
    df = spark.createDataFrame([("x", "p", 1), ("y", "p", 2), (None, "q", 3)], "a string, b string, n int")
    assert {r["column"]: r["values"] for r in tables.value_hints(df).collect()} == {"a": ["x", "y"], "b": ["p", "q"]}
    assert tables.cooccurrence(df, ["a", "b"]).count() == 3 and tables.cooccurrence(df, ["a", "b"], 2).count() == 0
    assert [r["n"] for r in tables.page(df, ["n"], 1, 1).collect()] == [2]
    facts = spark.createDataFrame([("f1", "s", 1.0, True), ("f2", "s", 2.0, False)], "source_file string, sheet string, value double, is_aggregate boolean")
    tables.write_facts(facts, str(tmp_path / "f"))
    tables.write_facts(facts.where("source_file = 'f1'").withColumn("value", F.lit(9.0)), str(tmp_path / "f"))
    assert sorted((r["source_file"], r["value"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [("f1", 9.0), ("f2", 2.0)]
    assert tables.ingest_summary(facts).count() == 2 and tables.duplicate_ids(facts.withColumnRenamed("sheet", "case_id")).count() == 1


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Satu" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Judul</t></si><si><r><t>Dua </t></r><r><t>bagian</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><fonts><font/><font><b/></font></fonts><fills><fill/></fills><borders><border/></borders><cellXfs><xf numFmtId="0"/><xf numFmtId="10" fontId="1"><alignment indent="2"/></xf></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2" s="1"><v>0.25</v></c><c r="C2" t="b"><v>1</v></c><c r="D2"/></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
    }
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    (tmp_path / "a.xlsx").write_bytes(raw.getvalue())
    got = [tuple(r)[3:] for r in xlsx.read_cells(spark, str(tmp_path)).orderBy("r", "c").collect()]
    assert got == [(0, 0, "text", "Judul", None, None, False, False, False, 0), (0, 27, "text", "Dua bagian", None, None, False, False, False, 0), (1, 0, "text", "x", None, None, False, False, False, 0), (1, 1, "num", None, 25.0, None, True, False, False, 2), (1, 2, "bool", None, 1.0, None, False, False, False, 0)]
    assert [tuple(r)[1:] for r in xlsx.read_merges(spark, str(tmp_path)).collect()] == [("a.xlsx / Satu", "Satu", 0, 1, 0, 2)]
    assert xlsx.sheet_names(spark, str(tmp_path)).first()["sheet"] == "Satu"


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2026-01-01 00:{i:02d}:00", "a", 1.5) for i in range(0, 60, 10)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.write.parquet(str(tmp_path / "in"))
    q = events.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["total"]) for r in spark.table("counts").collect()] == [(6, 9.0)]


def test_two_row_facts(spark):
    rows = [
        ["Survei", None, 2025, 2025, 2026, 2026],
        ["", "", "III", "IV", "I", "I"],
        ["A.", "Penjualan", 1, 2, 3, 4],
        ["-", "Makanan", 5, 6, 7, 8],
        [None, None, 2026, 2026],
        [None, None, "Q1", "Q2"],
        ["B.", "Harga", 9, 10],
    ]
    got = {(r["row_label"], r["year"], r["period"]): r["value"] for r in grid.two_row_facts(sheet(spark, rows)).collect()}
    assert got == {("Penjualan", 2025, "Q3"): 1, ("Penjualan", 2025, "Q4"): 2, ("Makanan", 2025, "Q3"): 5, ("Makanan", 2025, "Q4"): 6, ("Harga", 2026, "Q1"): 9, ("Harga", 2026, "Q2"): 10}


def test_tidy_facts(spark):
    rows = [["Laporan"], [None, "Semester 1", "Semester 1", "Total"], ["Produk", "Q1", "Q2", "Total"], ["Kopi", 1, 2, 3], ["Teh", 3, 4, 7], ["Total", 4, 6, 10]]
    cells = sheet(spark, rows).select("*", F.lit(False).alias("bold"), F.lit(False).alias("fill"), F.lit(False).alias("top_border"))
    got = {(r["row_label"], r["col_label"]): (r["value"], r["is_aggregate"]) for r in grid.tidy_facts(cells).collect()}
    assert got[("Kopi", "Semester 1 > Q1")] == (1, False) and got[("Teh", "Semester 1 > Q2")] == (4, False)
    assert got[("Total", "Semester 1 > Q1")] == (4, True) and got[("Kopi", "Total")] == (3, True) and len(got) == 9


def test_cascade(spark):
    kind = "source_id string, row_label string, row_ord int, year int, period string, value double"
    a = spark.createDataFrame([("s", "x", 0, 2026, "Jan", 1.0)], kind)
    b = spark.createDataFrame([("s", "y", 0, 2026, "Jan", 2.0), ("t", "y", 0, 2026, "Jan", 3.0), ("t", "y", 1, 2026, "Jan", 4.0)], kind)
    assert sorted((r["source_id"], r["parser"], r["value"]) for r in grid.cascade([a, b]).collect()) == [("s", 0, 1.0), ("t", 1, 3.0), ("t", 1, 4.0)]
    assert {r["source_id"]: r["collapsed"] for r in grid.collapsed(b).collect()} == {"s": False, "t": True}
