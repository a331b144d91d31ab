"""What hooks are shown of sheets, and which answers count."""

from factspan.operators import snapshots as S
from factspan.plans import hooks

CELLS = "source_id string, r int, c int, kind string, s_val string, d_val double"
ASKED = "source_id string, metric_label string, year int, col_label string"


def _cell(s, r, c, v):
    return (s, r, c, "num" if isinstance(v, float) else "text", None if isinstance(v, float) else v, v if isinstance(v, float) else None)


def _history(s, years, names):
    """Labels in column 0, twelve months for each year; the year stands over its first month only."""
    out = [_cell(s, 0, 0, "History")] + [_cell(s, 1, 1 + 12 * i, float(y)) for i, y in enumerate(years)]
    for i in range(12 * len(years)):
        out.append(_cell(s, 2, 1 + i, f"m{i % 12 + 1}"))
    for k, name in enumerate(names):
        out.append(_cell(s, 7 + k, 0, name))
        out += [_cell(s, 7 + k, 1 + i, 1000.0 * k + i) for i in range(12 * len(years))]
    return out


def _plain(cells, metrics, years, n_top=6):
    """The rows and columns of one sheet that the rules choose, by loops."""
    import re

    words = lambda t: {w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 2}
    n_rows, n_cols = max(x[1] for x in cells) + 1, max(x[2] for x in cells) + 1
    wanted = [words(m) for m in metrics]
    rows = None
    if all(wanted):
        rows = set(range(min(n_top, n_rows))) | {x[1] for x in cells if any(words(x[4]) & w for w in wanted)}
    hit = {x[2] for x in cells if x[1] < n_top and any(str(y) in (x[4] or str(int(x[5]))) for y in years)}
    on = [x for x in cells if rows is None or x[1] in rows]
    names = {x[2] for x in on if x[3] == "text"} - {x[2] for x in on if x[3] == "num"}
    block = {c for h in hit for c in range(h, min(h + 13, n_cols))} - names
    if not hit or len(block | names) >= 0.6 * n_cols:
        return rows, None
    return rows, names | set(sorted(block)[-max(100 - len(names), 0):] if len(names) < 100 else [])


def test_selection_equals_loops(spark):
    sheets = {
        "long": _history("long", range(2010, 2024), ["steel exports", "rice imports", "tea"]),
        "short": _history("short", [2023], ["steel exports", "rice imports"]),
        "wide": _history("wide", range(1990, 2024), ["steel exports"]),
    }
    asks = {"long": (["Steel total"], [2012, 2020]), "short": (["rice"], [2023]), "wide": (["M2", "steel"], [*range(1992, 2006)])}
    cells = spark.createDataFrame([x for s in sheets.values() for x in s], CELLS)
    asked = spark.createDataFrame([(s, m, y, None) for s, (ms, ys) in asks.items() for m in ms for y in ys], ASKED)
    rows = S.relevant_rows(cells, asked)
    got_rows, got_cols = {}, {}
    for r in rows.collect():
        got_rows.setdefault(r.source_id, set()).add(r.r)
    for r in S.relevant_columns(cells, asked, rows).collect():
        got_cols.setdefault(r.source_id, set()).add(r.c)
    for s in sheets:
        want = _plain(sheets[s], *asks[s])
        assert (got_rows.get(s), got_cols.get(s)) == want, s
    assert got_cols["long"] and "short" not in got_cols and len(got_cols["wide"]) == 100
    views = {r.source_id: r for r in S.snapshots(cells, asked).collect()}
    assert {s: v["view"] for s, v in views.items()} == {"long": "selected", "short": "whole", "wide": "selected"}
    assert "[25]='2012'" in views["long"].snapshot and "rice" not in views["long"].snapshot and "row 5: (empty)" in views["long"].snapshot


def test_text_of_a_sheet(spark):
    cells = spark.createDataFrame([_cell("a", 0, 0, "x" * 31), _cell("a", 0, 2, 1.5), _cell("a", 2, 1, 7.0), _cell("a", 2, 0, " "), _cell("b", 0, 0, "not asked"), ("a", 1, 0, "text", None, None)], CELLS)
    asked = spark.createDataFrame([("a", None, None, None), ("a", "x", None, None), ("c", "no such sheet", 2020, None)], ASKED)
    (row,) = S.snapshots(cells, asked).collect()
    assert (row.source_id, row.view, row.n_rows, row.n_cols) == ("a", "whole", 3, 3)
    assert row.snapshot == f"row 0: [0]='{'x' * 30}…' [2]='1.5'\nrow 1: (empty)\nrow 2: [1]='7'"
    assert S.snapshots(cells.limit(0), asked).count() == 0 and S.snapshots(cells, asked.limit(0)).count() == 0


def test_long_sheets_are_cut(spark):
    cells = spark.createDataFrame([_cell("a", r, 0, f"item {r}") for r in range(200)], CELLS)
    view = lambda metric: S.snapshots(cells, spark.createDataFrame([("a", metric, None, None)], ASKED)).first()
    assert (view("M2").view, view("M2").snapshot.count("\n")) == ("truncated", 119)
    assert view("item").view == "truncated" and view("unknown").view == "selected"
    assert view("unknown").snapshot.count("\n") == 5


def test_labels_and_answers(spark):
    labels = spark.createDataFrame([("a", "Trade", i, f"l{i % 70}") for i in range(140)] + [("a", "Trade", 0, None)], "source_id string, description string, ord int, label string")
    (row,) = S.advertised_labels(labels).collect()
    assert row.block.split("\n") == ["[Trade]"] + [f"  - l{i}" for i in range(60)]
    answers = [("a", 0, 0, False, 1, 1), ("a", 0, 1, True, 2, 2), ("a", 0, 2, True, 3, 3), ("a", 1, 3, True, None, 1), ("a", 9, 4, True, 1, 1), ("a", None, 5, True, 1, 1)]
    answers = spark.createDataFrame(answers, "source_id string, query int, ord int, found boolean, r int, c int")
    asked = spark.createDataFrame([("a", 0), ("a", 1)], "source_id string, query int")
    assert [tuple(r) for r in S.counted_answers(answers, asked).collect()] == [("a", 0, 2, 2)]


def test_hooks_fail_one_by_one():
    def some(xs):
        if "bad" in xs:
            raise ValueError
        return [x.upper() for x in xs]

    assert hooks.one_by_one(some, ["a", "bad", "b"]) == ["A", None, "B"]
    assert hooks.one_by_one(lambda xs: ["too many"] * (len(xs) + 1) if len(xs) > 1 else xs, ["a", "b"]) == ["a", "b"]
    assert hooks.first_of(some, lambda xs: [x + "?" for x in xs])(["a", "bad", "b"]) == ["A", "bad?", "B"]
    assert hooks.first_of(some, hooks.no_answer)([]) == []
