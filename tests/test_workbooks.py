"""From files to facts: sheets of every layout, written as workbooks and read back."""

import io
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest

from factspan.operators import grid
from factspan.sources import xlsx

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
#: Styles by number: plain, percent, date, and indents 1 and 2.
STYLES = f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="[$-421]mmm\\-yy;@"/></numFmts><fonts><font/></fonts><fills><fill/></fills><borders><border/></borders><cellXfs><xf/><xf numFmtId="9"/><xf numFmtId="170"/><xf><alignment indent="1"/></xf><xf><alignment indent="2"/></xf></cellXfs></styleSheet>'


def ref(r, c):
    return f"{chr(65 + c)}{r + 1}"


def workbook(path, sheets):
    """``sheets``: name to rows of values or (value, style), and merged ranges."""
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="o"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", STYLES)
        for k, (rows, merges) in enumerate(sheets.values(), 1):
            out = io.StringIO()
            for r, row in enumerate(rows):
                for c, v in enumerate(row):
                    v, style = v if isinstance(v, tuple) else (v, 0)
                    if isinstance(v, str):
                        out.write(f'<c r="{ref(r, c)}" t="inlineStr" s="{style}"><is><t>{escape(v)}</t></is></c>')
                    elif v is not None:
                        out.write(f'<c r="{ref(r, c)}" s="{style}"><v>{v}</v></c>')
            ranges = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {NS}><sheetData><row>{out.getvalue()}</row></sheetData><mergeCells>{ranges}</mergeCells></worksheet>")


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    months = ["Nov", "Dec", "Jan", "Feb", "Mar"]
    folder = tmp_path_factory.mktemp("books")
    workbook(
        folder / "book.xlsx",
        {
            "stat": ([["Produksi"], ["(ton)"], [None, None, None, None, 2020, None, 2021], [None, None, None, *[m + "*" for m in months]][:8], [None, None, "Laut", 1, 2, 3, 4, 5], [None, None, ("Ikan", 3), 6, 7, 8, 9, 10], [None, None, "Darat", None, 11], [None, None, ("Ikan", 3), 12, 13], [None, None, "1) catatan"], [None, None, "Ikan", 99]], []),
            "two": ([["Hasil"], [None, 2020, None, 2021, None], ["Bagian", "III", "IV", "I", "II"], ["Kebun"], [None], ["- ", 1, 2, 3, 4], ["Teh", 5, None, 7, 8]], ["B2:C2", "D2:E2"]),
            "dates": ([["Harga"], ["(Rp)"], ["Barang", (43983, 2), (44013, 2), "Agu 2020"], ["Beras", 10, (0.5, 1), 12], ["Gula", 20, 21, 22]], []),
            "places": ([["Barang", "Stok", "Harga (Rp)"], ["Beras", 5, 7], ["Gula", 6, 8], ["Beras", 9, 9]], []),
            "notes": ([["hanya catatan"]], []),
        },
    )
    cells = xlsx.read_cells(spark, str(folder)).checkpoint()
    sources, facts = grid.parse_sheets(cells, xlsx.read_merges(spark, str(folder)))
    rows = {}
    for f in facts.collect():
        rows.setdefault(f["source_id"].rpartition(" ")[2], {})[f["row_label"], f["year"], f["period"], f["col_label"]] = f["value"]
    return cells, {r["source_id"].rpartition(" ")[2]: r for r in sources.collect()}, rows


def test_layouts(parsed):
    _, sources, facts = parsed
    assert {k: (r["parser"], r["title"], r["unit"], r["axis"]) for k, r in sources.items()} == {
        "stat": ("statistical", "Produksi", "ton", "temporal"), "two": ("two_row", "Hasil", None, "temporal"), "dates": ("single_header", "Harga", "Rp", "temporal"),
        "places": ("single_header", None, None, "categorical"), "notes": (None, None, None, "temporal"),
    }
    assert "notes" not in facts


def test_statistical(parsed):
    got = parsed[2]["stat"]
    at = [(2021, "Jan"), (2021, "Feb"), (2021, "Mar")]
    assert {k[0] for k in got} == {"Laut", "Laut > Ikan"}  # the months before the first January have no year
    assert [got["Laut", y, m, None] for y, m in at] == [3, 4, 5] and [got["Laut > Ikan", y, m, None] for y, m in at] == [8, 9, 10]


def test_two_rows(parsed):
    got = parsed[2]["two"]
    assert got == {("Kebun", 2020, "Q3", None): 1, ("Kebun", 2020, "Q4", None): 2, ("Kebun", 2021, "Q1", None): 3, ("Kebun", 2021, "Q2", None): 4, ("Teh", 2020, "Q3", None): 5, ("Teh", 2021, "Q1", None): 7, ("Teh", 2021, "Q2", None): 8}


def test_dates_and_percent(parsed):
    cells, _, facts = parsed
    assert facts["dates"] == {(w, 2020, m, None): v for w, vs in (("Beras", (10, 50, 12)), ("Gula", (20, 21, 22))) for m, v in zip(("Jun", "Jul", "Aug"), vs, strict=True)}
    assert [r[0] for r in cells.where("kind = 'date'").select("ts_val").orderBy("c").collect()] == [datetime(2020, 6, 1), datetime(2020, 7, 1)]
    assert facts["places"] == {("Beras", None, None, "Stok"): 5, ("Beras", None, None, "Harga (Rp)"): 7, ("Gula", None, None, "Stok"): 6, ("Gula", None, None, "Harga (Rp)"): 8}


def test_anchored_columns(spark):
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    cols = spark.createDataFrame([("s", 3 + k, m) for k, m in enumerate(months * 2 + months[:3])] + [("t", 3, "Feb")], "source_id string, c int, period string")
    anchors = spark.createDataFrame([("s", 14, 2019), ("s", 15, 2020), ("s", 28, 2021), ("s", 29, 2019), ("t", 3, 2020)], "source_id string, c int, year int")
    got = {(r["source_id"], r["c"]): r["year"] for r in grid.anchored_columns(cols, anchors).collect()}
    assert got == {("s", 3 + k): 2019 + k // 12 for k in range(27)}


def test_printed_tables(spark):
    kind = "table_id int, r int, cells array<string>"
    heads = spark.createDataFrame([(1, 0, ["2020", "2021"]), (2, 0, ["", "Jan"]), (3, 0, ["Jan"]), (4, 0, ["", "Jan"])], kind)
    body = spark.createDataFrame([(1, 1, ["Beras", "1,5", "2"]), (1, 2, ["Gula", "3", "4"]), (2, 1, ["Beras", "x"]), (2, 2, ["Gula", "y"]), (3, 1, ["Beras", "1"]), (4, 1, ["a", "1"]), (4, 2, [" ", "Jan "])], kind)
    assert {r["table_id"]: r["cells"] for r in grid.pad_header(heads, body).collect()} == {1: [None, "2020", "2021"], 2: ["", "Jan"], 3: [None, "Jan"], 4: ["", "Jan"]}
    assert [r["table_id"] for r in grid.usable_tables(heads, body).collect()] == [1]


def test_specs(spark, parsed):
    cells = parsed[0].where("sheet = 'places'")
    (sid,) = [r[0] for r in cells.select("source_id").distinct().collect()]
    column = "struct<col:int,kind:string,year:int,period:string,name:string>"
    kind = f"source_id string, axis string, header_row int, data_start_row int, label_col int, columns array<{column}>"
    good = [(1, "attribute", None, None, " Sisa "), (2, "attribute", None, None, "Sisa")]
    facts, problems = grid.spec_facts(cells, spark.createDataFrame([(sid, "categorical", 0, 1, 0, good)], kind))
    assert {(r["row_label"], r["col_label"]): r["value"] for r in facts.collect()} == {("Beras", "Sisa"): 5, ("Gula", "Sisa"): 6} and problems.count() == 0
    for spec, said in [
        (("categorical", 1, 1, 0, good), "rows out of order"), (("categorical", 0, 1, 3, good), "no such label column"), (("categorical", 0, 1, 0, []), "no columns"), (("categorical", 0, 1, 1, good), "a column twice"),
        (("temporal", 0, 1, 0, good), "a column that does not fit the axis"), (("temporal", 0, 1, 0, [(1, "period", 2020, "Foo", None)]), "a column that does not fit the axis"), (("categorical", 0, 1, 1, [(0, "attribute", None, None, "x")]), "no labelled numbers"),
    ]:
        facts, problems = grid.spec_facts(cells, spark.createDataFrame([(sid, *spec)], kind))
        assert [r["problem"] for r in problems.collect()] == [said] and facts.count() == 0, said
