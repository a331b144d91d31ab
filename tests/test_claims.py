"""Labelled claims over small tables: verdict, computed value and conflict."""

import pytest

from factspan.operators import claims, resolve
from factspan.queries import order_facts  # noqa: F401  (the module must import without data)

SOURCES = "source_id string, source_ord int, name string, origin string, title string, unit string, axis string"
FACTS = "source_id string, row_label string, row_ord int, year int, period string, col_label string, value double"
CLAIMS = "claim_id string, operation string, claimed_value double, unit string, quote string, points array<struct<ord:int,metric_label:string,year:int,period:string,col_label:string>>"

MONEY = [("Kredit", "Jan", 100.0, 90.0), ("Kredit", "Feb", 110.0, 100.0), ("Kredit", "Mar", 108.0, 0.0), ("Simpanan Berjangka (Rupiah dan Valas)", "Jan", 50.0, 40.0), ("Total", "Jan", 150.0, 130.0)]


def dated(*points):
    return [(i, m, y, p, None) for i, (m, y, p) in enumerate(points)]


@pytest.fixture(scope="module")
def tables(spark):
    sources = spark.createDataFrame(
        [
            ("a", 0, "Report / T1", "pdf", "Posisi Simpanan dan Kredit", "triliun Rp", "temporal"),
            ("b", 1, "Book / S1", "excel", "Kredit", "miliar Rp", "temporal"),
            ("c", 2, "Report / T2", "pdf", "Harga Barang", None, "categorical"),
            ("g", 3, "Report / T3", "pdf", "Indeks", "%, yoy", "temporal"),
            ("d", 4, "Report / T4", "pdf", "Uang", "triliun Rp", "temporal"),
            ("e", 5, "Report / T5", "pdf", "Uang", "triliun Rp", "temporal"),
        ],
        SOURCES,
    )
    rows = [("a", lab, k, y, p, None, v) for k, (lab, p, *vs) in enumerate(MONEY) for y, v in zip((2026, 2025), vs, strict=True)]
    rows += [("b", "Kredit", 0, 2026, "Jan", None, 100_000.0), ("b", "Kredit", 0, 2026, "Feb", None, 111_000.0), ("b", "Kredit Properti", 1, 2026, "Jan", None, 7.0)]
    rows += [("c", "Beras", 0, None, None, "Harga (juta Rp)", 0.015), ("c", "Beras", 0, None, None, "Stok", 12.0), ("c", "Gula", 1, None, None, "Stok", 30.0)]
    rows += [("g", "IHK", 0, 2026, "Q1", None, 3.5), ("g", "IHK", 0, 2025, "Q4", None, 3.4), ("g", "IHK > Makassar", 1, 2026, "Q1", None, 4.0), ("g", "IHK > Medan", 2, 2026, "Q1", None, 2.0)]
    rows += [("d", "M2", 0, 2026, "Apr", None, 10.0), ("e", "M2", 0, 2026, "Apr", None, 10.2), ("d", "M1", 1, 2026, "Jan", None, 5.0)]
    rows += [("e", "M1", 1, y, "Jan", None, v) for y, v in ((2026, 5.0), (2025, 4.0))]
    return sources, spark.createDataFrame(rows, FACTS)


CASES = {
    # values and units
    "level": ("value", 100.0, "triliun Rp", dated(("Kredit", 2026, "Jan")), "Entailed", 100.0, None),
    "level_scaled": ("value", 108_000.0, "miliar Rp", dated(("Kredit", 2026, "Mar")), "Entailed", 108_000.0, None),
    "level_wrong": ("value", 101.0, "triliun Rp", dated(("Kredit", 2026, "Mar")), "Refuted", 108.0, None),
    "fuller_label": ("value", 50.0, "triliun Rp", dated(("simpanan berjangka", 2026, "Jan")), "Entailed", 50.0, None),
    "no_such_row": ("value", 1.0, "triliun Rp", dated(("suku bunga simpanan tenor", 2026, "Jan")), "Inconclusive", None, None),
    "unit_unknown": ("value", 1.0, "juta usd", dated(("Kredit", 2026, "Mar")), "Inconclusive", None, None),
    # growth
    "growth": ("yoy_growth", 25.0, "persen_yoy", dated(("Simpanan Berjangka (Rupiah dan Valas)", 2026, "Jan")), "Entailed", 25.0, None),
    "growth_zero_base": ("yoy_growth", 1.0, "persen_yoy", dated(("Kredit", 2026, "Mar")), "Inconclusive", None, None),
    "growth_series": ("yoy_growth", 3.5, "persen_yoy", dated(("IHK", 2026, "Q1")), "Entailed", 3.5, None),
    "growth_from_other_source": ("yoy_growth", 25.0, "persen_yoy", dated(("M1", 2026, "Jan")), "Entailed", 25.0, None),
    # aggregates
    "average": ("average", 106.0, "triliun Rp", dated(("Kredit", 2026, "Jan"), ("Kredit", 2026, "Feb"), ("Kredit", 2026, "Mar")), "Entailed", 106.0, None),
    "sum": ("sum", 218.0, "triliun Rp", dated(("Kredit", 2026, "Feb"), ("Kredit", 2026, "Mar")), "Entailed", 218.0, None),
    "diff": ("diff", 8.0, "triliun Rp", dated(("Kredit", 2026, "Jan"), ("Kredit", 2026, "Mar")), "Entailed", 8.0, None),
    "diff_is_level": ("diff", 108.0, "triliun Rp", dated(("Kredit", 2026, "Jan"), ("Kredit", 2026, "Mar")), "Entailed", 108.0, None),
    # ratio
    "ratio": ("ratio", 50.0, "persen", dated(("Simpanan Berjangka (Rupiah dan Valas)", 2026, "Jan"), ("Kredit", 2026, "Jan")), "Entailed", 50.0, None),
    "ratio_sign": ("ratio", 50.0, "%", dated(("Simpanan Berjangka (Rupiah dan Valas)", 2026, "Jan"), ("Kredit", 2026, "Jan")), "Refuted", 0.5, None),
    # trends
    "rises": ("is_increasing", None, None, dated(("Kredit", 2026, "Jan"), ("Kredit", 2026, "Mar")), "Entailed", None, None),
    "falls": ("is_decreasing", None, None, dated(("Kredit", 2026, "Jan"), ("Kredit", 2026, "Mar")), "Refuted", None, None),
    "stable": ("is_stable", None, None, dated(("Kredit", 2026, "Feb"), ("Kredit", 2026, "Mar")), "Entailed", None, None),
    "one_period": ("is_increasing", None, None, dated(("IHK", 2026, "Q1")), "Entailed", None, None),
    "no_period_before": ("is_increasing", None, None, dated(("M2", 2026, "Apr")), "Inconclusive", None, None),
    "two_metrics": ("is_increasing", None, None, dated(("Kredit", 2026, "Jan"), ("Total", 2026, "Jan")), "Inconclusive", None, None),
    # thresholds
    "above": ("above_threshold", 3.4, None, dated(("IHK", 2026, "Q1")), "Entailed", 3.5, None),
    "at_the_bound": ("above_threshold", 3.5, None, dated(("IHK", 2026, "Q1")), "Refuted", 3.5, None),
    "below": ("below_threshold", 3.6, None, dated(("IHK", 2026, "Q1")), "Entailed", 3.5, None),
    "no_bound": ("above_threshold", None, None, dated(("IHK", 2026, "Q1")), "Inconclusive", 3.5, None),
    # categorical
    "cell": ("value", 12.0, None, [(0, "beras", None, None, "stok")], "Entailed", 12.0, None),
    "cell_unit": ("value", 15.0, "ribu Rp", [(0, "Beras", None, None, "harga")], "Entailed", 15.0, None),
    "cell_sum": ("sum", 42.0, None, [(0, "Beras", None, None, "Stok"), (1, "Gula", None, None, "Stok")], "Entailed", 42.0, None),
    "cell_missing": ("value", 1.0, None, [(0, "Gula", None, None, "Harga")], "Inconclusive", None, None),
    "cell_trend": ("is_increasing", None, None, [(0, "Beras", None, None, "Stok")], "Inconclusive", None, None),
    # sources
    "conflict_cross": ("value", 110.0, "triliun Rp", dated(("Kredit", 2026, "Feb")), "Entailed", 110.0, "cross"),
    "conflict_internal": ("value", 10.0, "triliun Rp", dated(("M2", 2026, "Apr")), "Entailed", 10.0, "internal"),
    "sources_agree": ("value", 5.0, "triliun Rp", dated(("M1", 2026, "Jan")), "Entailed", 5.0, None),
    "total_by_subject": ("value", 150.0, "triliun Rp", dated(("penghimpunan DPK", 2026, "Jan")), "Entailed", 150.0, None),
}


def test_labelled_claims(spark, tables):
    rows = [(k, op, v, u, None, p) for k, (op, v, u, p, *_) in CASES.items()]
    rows.append(("subset", "above_threshold", 1.0, None, "di atas 1 pada sebagian besar kota", dated(("IHK > Medan", 2026, "Q1"))))
    rows.append(("member", "above_threshold", 1.0, None, "naik di sebagian besar kota, terutama Medan", dated(("IHK > Medan", 2026, "Q1"))))
    got = {r["claim_id"]: r for r in claims.evaluate(spark.createDataFrame(rows, CLAIMS), *tables).collect()}
    assert len(got) == len(rows)
    for k, (_, _, _, _, verdict, value, conflict) in CASES.items():
        r = got[k]
        near = r["computed_value"] is None if value is None else r["computed_value"] is not None and abs(r["computed_value"] - value) <= 0.05
        assert (r["verdict"], near, r["source_conflict"]) == (verdict, True, conflict), (k, r)
    assert {op for op, *_ in CASES.values()} == set(claims.OPERATIONS)
    assert got["diff_is_level"]["operation"] == "value"
    assert (got["subset"]["reason"], got["member"]["verdict"]) == ("unnamed subset", "Entailed")
    assert got["growth_from_other_source"]["matched_source"] == "Report / T5"


def test_reasons(spark, tables):
    rows = [
        ("unit", "value", 1.0, "miliar dolar AS", None, dated(("Kredit", 2026, "Jan"))),
        ("some", "sum", 1.0, "triliun Rp", None, dated(("Kredit", 2026, "Jan"), ("Kredit", 2026, "Dec"), ("Total", 2026, "Jan"))),
        ("none", "value", 1.0, None, None, [(0, "Jagung", None, None, "Bobot")]),
        ("told", "yoy_growth", 1.0, None, None, [(0, "Beras", None, None, "Stok")]),
    ]
    got = {r["claim_id"]: (r["verdict"], r["reason"]) for r in claims.evaluate(spark.createDataFrame(rows, CLAIMS), *tables).collect()}
    assert {v for v, _ in got.values()} == {"Inconclusive"}
    assert got["unit"][1] == "unit miliar dolar AS does not convert to triliun Rp of Report / T1"
    assert got["some"][1] == "no source answers: Kredit Dec 2026"
    assert (got["none"][1], got["told"][1]) == ("no source answers: Jagung (Bobot)", "needs a time series")


def test_no_claims(spark, tables):
    assert claims.evaluate(spark.createDataFrame([], CLAIMS), *tables).count() == 0


def test_deduplicate(spark):
    p = dated(("Kredit", 2026, "Jan"))
    df = spark.createDataFrame([("a", "value", 1.0, None, None, p, 2), ("b", "value", 2.0, None, None, p, 1), ("c", "sum", 1.0, None, None, p, 3)], CLAIMS + ", claim_ord int")
    assert sorted(r["claim_id"] for r in claims.deduplicate(df).collect()) == ["b", "c"]


def test_resolver(spark):
    labels = ["Kredit", "Kredit Modal Kerja", "Simpanan", "Simpanan Berjangka > Rupiah", "Tabungan Lainnya > Rupiah", "Total"]
    lab = spark.createDataFrame([("s", x, i, "Posisi Simpanan Masyarakat") for i, x in enumerate(labels)], "source_id string, row_label string, row_ord int, title string")
    want = {
        "kredit": ("Kredit", 1),
        "Modal Kerja": ("Kredit Modal Kerja", 2),
        "tabungan lainnya rupiah": ("Tabungan Lainnya > Rupiah", 3),
        "kredit yang disalurkan": ("Kredit", 4),
        "Penghimpunan DPK": ("Total", 5),
        "Kredit": ("Kredit", 0),
        "uang beredar digital": None,
        "Kredit > Makassar": None,
    }
    got = {r["query"]: (r["label"], r["tier"]) for r in resolve.resolve_labels(spark.createDataFrame([("s", q) for q in want], "source_id string, query string"), lab).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_data_beats_a_better_name(spark):
    lab = spark.createDataFrame([("s", "Kredit", 0, ""), ("s", "Kredit Konsumsi", 1, "")], "source_id string, row_label string, row_ord int, title string")
    facts = spark.createDataFrame([("s", "Kredit Konsumsi", 1, 2026, "Jan", None, 3.0)], FACTS)
    points = spark.createDataFrame([("s", "kredit", 2026, "Jan"), ("s", "kredit", 2026, "Feb")], "source_id string, query string, year int, period string")
    assert [tuple(r) for r in resolve.lookup_period(points, lab, facts).collect()] == [("s", "kredit", 2026, "Jan", "Kredit Konsumsi", 3.0)]
