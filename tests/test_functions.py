import pytest
from pyspark.sql import functions as F

from factspan.functions import labels as L
from factspan.functions import numbers as N
from factspan.functions import periods as P


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    cases = {
        "20.417,6": 20417.6, "3,3": 3.3, "-7,1": -7.1, "6.051": 6051.0, "Rp20.417,6 triliun": 20417.6, "(31,4)": -31.4, "(8.102,5)": -8102.5,
        "(31,4) triliun": -31.4, "(-31,4)": -31.4, "(2,5%)": 2.5, "4 7,2": 47.2, "18,6 %": 18.6, "33*": 33.0, "": None, "abc": None, "n.a.": None, "1,2,3": None,
    }
    got = column(spark, list(cases), N.parse_number)
    assert [None if v is None else round(v, 6) for v in got] == list(cases.values())
    assert column(spark, [None], N.parse_number) == [None]


def test_units(spark):
    cases = {"juta Rp": (1e6, "rp"), "Rp": (1.0, "rp"), "miliar dolar AS": (1e9, "usd"), "miliar": (1e9, None), "persen": None, "persen_yoy": None, "%": None, "unit": None, "ribu juta idr": (1e9, "rp"), "": None}
    assert [None if r is None else tuple(r) for r in column(spark, list(cases), N.parse_unit)] == list(cases.values())
    pairs = [("juta Rp", "Rp", 1e6), ("miliar dolar AS", "juta USD", 1000.0), ("juta Rp", "juta USD", None), ("Unit", "unit", 1.0), (None, "Rp", None), ("miliar", "juta Rp", None)]
    df = spark.createDataFrame([(a, b, i) for i, (a, b, _) in enumerate(pairs)], "a string, b string, i int")
    rows = df.select("i", N.unit_factor(F.col("a"), F.col("b")).alias("f"), N.units_comparable(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()
    assert [r["f"] for r in rows] == [p[2] for p in pairs]
    assert [r["c"] for r in rows] == [True, True, False, True, False, False]
    assert column(spark, ["Ongkos (USD)", "Hasil (ribu Rp) ", "Sisa"], N.column_unit) == ["USD", "ribu Rp", None]
    assert column(spark, ["%, yoy", "persen_yoy", None], N.is_growth_unit) == [True, False, False]


def test_tolerance(spark):
    df = spark.createDataFrame([(10.0, 10.05004), (10.0, 10.0501), (0.0, -0.05)], "a double, b double")
    assert [r[0] for r in df.select(N.verdict(F.col("a"), F.col("b"))).collect()] == ["Entailed", "Refuted", "Entailed"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Jun 2019", (2019, "Jun")), ("Agustus 2019", (2019, "Aug")), ("Okt-19", (2019, "Oct")), ("Feb'19*", (2019, "Feb")), ("Nop 2018", (2018, "Nov")),
        ("2019 Mei", (2019, "May")), ("2019M11", (2019, "Nov")), ("07/2019", (2019, "Jul")), ("Q3 2019", (2019, "Q3")), ("Tw III 2019", (2019, "Q3")), ("Q III 2019", None), ("Kuartal 2 2019", (2019, "Q2")),
        ("2019Q4", (2019, "Q4")), ("II 2019", (2019, "Q2")), ("Triwulan I 2018", (2018, "Q1")), ("Mar 75", None), ("Sep 97", (1997, "Sep")), ("14/2019", None),
        ("Subtotal", None), ("Bobot", None), ("2019", None), ("Jun", None), ("Q3", None), ("", None), (None, None),
    ],
)
def test_periods(spark, text, want):
    (got,) = column(spark, [text], P.parse_period)
    assert (None if got is None else tuple(got)) == want


def test_bare_tokens(spark):
    assert column(spark, ["III", "tw.1", "Triwulan ii", "Agt*", "Bobot", "twi", "q ii", None], P.bare_token) == ["Q3", "Q1", "Q2", "Aug", None, None, None, None]


def test_labels(spark):
    assert column(spark, ["Usia 31 -  40  tahun", " C / d "], L.canonical) == ["usia 31-40 tahun", "c/d"]
    assert column(spark, ["Ekspor  Hasil Laut ekspor (EHL)", None], L.significant_words) == [["ekspor", "hasil", "laut", "ehl"], None]
    assert column(spark, ["C.", "7)", "-", "D2.", "Ekspor"], L.is_marker) == [True, True, True, True, False]
    assert column(spark, ["A > B > C", "D"], L.leaf) == ["C", "D"]
    df = spark.createDataFrame([(["x", " X ", None, "", "y"],)], "p array<string>")
    assert df.select(L.composite(F.col("p"))).first()[0] == "x > y"


def test_label_rules(spark):
    df = spark.createDataFrame(
        [
            ("harga rata rata minyak goreng kemasan", "Minyak Goreng", "Volume Ekspor"),
            ("volume beras", "Beras", ""),
            ("beras impor musiman", "Beras", "Impor Musiman"),
            ("Survei > jenis pekerjaan lainnya", "Lainnya", ""),
            ("Survei > Ambon", "Kota Ambon", ""),
        ],
        "q string, l string, t string",
    )
    q, lab, t = F.col("q"), F.col("l"), F.col("t")
    rows = df.select(L.query_is_about(q, lab, t).alias("a"), L.qualifier_kept(q, lab).alias("k")).collect()
    assert [r["a"] for r in rows[:3]] == [False, True, True]
    assert [r["k"] for r in rows[3:]] == [False, True]
    df = spark.createDataFrame([("Saldo DPK", "Saldo Simpanan Warga"), ("DPK perusahaan", "Saldo Simpanan Warga"), ("Hasil Tambang", "Hasil Tambang Daerah"), ("Total", "Hasil"), ("Dana Pihak Ketiga", "Simpanan")], "q string, t string")
    assert [r[0] for r in df.select(L.query_names_subject(F.col("q"), F.col("t"))).collect()] == [True, False, True, False, True]
