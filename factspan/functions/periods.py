"""Months and quarters as printed in headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factspan.functions.core import let, lookup

#: Canonical tokens, and the spellings of months.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
QUARTERS = ["Q1", "Q2", "Q3", "Q4"]
MONTH_FORMS = {
    "Jan": ["jan", "januari", "january"],
    "Feb": ["feb", "februari", "february", "peb"],
    "Mar": ["mar", "mrt", "maret", "march"],
    "Apr": ["apr", "april"],
    "May": ["may", "mei"],
    "Jun": ["jun", "juni", "june"],
    "Jul": ["jul", "juli", "july"],
    "Aug": ["aug", "agu", "ags", "agt", "agustus", "august"],
    "Sep": ["sep", "sept", "september"],
    "Oct": ["oct", "okt", "oktober", "october"],
    "Nov": ["nov", "nop", "november"],
    "Dec": ["dec", "des", "desember", "december"],
}
MONTH_OF = {form: token for token, forms in MONTH_FORMS.items() for form in forms}
ORDINAL_OF = {m: i for i, m in enumerate(MONTHS, 1)} | {q: i for i, q in enumerate(QUARTERS, 1)}

#: What stands before a quarter's number, each in the spacing that is read, and Roman numbers.
QUARTER_NAMES = ["q", "q ", "tw", "tw ", "triwulan ", "kuartal "]
ROMANS = ["i", "ii", "iii", "iv"]
_SEP = r"[\s.\-/']*"
_QUARTER = r"(?:q|tw|triwulan|kuartal)[\s.]*(?:[1-4]|[iv]+)|[iv]+"


def _quarter(text: Column) -> Column:
    """Q1 to Q4 for a name and a number, or a Roman number alone or after a name that takes one; else null.

    Only a name of two letters or more and a blank stands before a Roman number.
    """
    t = F.lower(F.trim(F.regexp_replace(text, r"[\s.]+", " ")))
    digit = F.regexp_extract(t, rf"^(?:{'|'.join(QUARTER_NAMES)})([1-4])$", 1)
    spaced = "|".join(n for n in QUARTER_NAMES if len(n) > 2 and n.endswith(" "))
    roman = F.regexp_extract(t, rf"^(?:{spaced})?({'|'.join(ROMANS)})$", 1)
    place = F.array_position(F.array(*map(F.lit, ROMANS)), roman)
    return F.when(digit != "", F.concat(F.lit("Q"), digit)).when(place > 0, F.concat(F.lit("Q"), place.cast("string")))


def quarter_token(text: Column) -> Column:
    """Q1 to Q4 for a bare quarter, or null."""
    return _quarter(F.regexp_replace(F.trim(text), r"\*+$", ""))


def month_token(text: Column) -> Column:
    """Jan to Dec for a bare month, or null."""
    return lookup(MONTH_OF, F.lower(F.trim(F.regexp_replace(F.trim(text), r"\*+$", ""))))


def bare_token(text: Column) -> Column:
    """The token of a header cell without a year, or null."""
    return F.coalesce(quarter_token(text), month_token(text))


def year_of(digits: Column) -> Column:
    """A year of two or four digits between 1990 and 2100, or null."""
    n = digits.try_cast("int")
    full = F.when(F.length(digits) == 2, n + F.when(n < 70, 2000).otherwise(1900)).otherwise(n)
    return F.when(full.between(1990, 2100), full)


def parse_period(text: Column) -> Column:
    """``struct(year, period)`` of a header cell with month or quarter and year, or null."""
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\*+$", ""))

    def read(t: Column) -> Column:
        pick = lambda p, k: F.regexp_extract(t, p, k)

        def found(year: Column, token: Column) -> Column:
            return F.when(year.isNotNull() & token.isNotNull(), F.struct(year.alias("year"), token.alias("period")))

        name = lambda p, k: F.coalesce(lookup(MONTH_OF, F.lower(pick(p, k))), _quarter(pick(p, k)))
        month = lambda p, k: F.get(F.array(*map(F.lit, MONTHS)), pick(p, k).try_cast("int") - 1)
        quarter = lambda p, k: _quarter(pick(p, k))
        forms = [
            (rf"^([A-Za-z]+){_SEP}(\d{{2}}|\d{{4}})$", 2, 1, name),
            (rf"^(\d{{4}}){_SEP}([A-Za-z]+)$", 1, 2, name),
            (r"^(\d{4})[Mm\-/](\d{1,2})$", 1, 2, month),
            (r"^(\d{1,2})[\-/](\d{4})$", 2, 1, month),
            (rf"^(?i)({_QUARTER}){_SEP}(\d{{2}}|\d{{4}})$", 2, 1, quarter),
            (rf"^(?i)(\d{{4}}){_SEP}({_QUARTER})$", 1, 2, quarter),
        ]
        out = None
        for p, y, n, kind in forms:
            hit = found(year_of(pick(p, y)), kind(p, n))
            out = F.when(t.rlike(p), hit) if out is None else out.when(t.rlike(p), hit)
        return out

    return let(clean, read)


def ordinal(period: Column) -> Column:
    """1 to 12 for months, 1 to 4 for quarters, 0 for anything else."""
    return F.coalesce(lookup(ORDINAL_OF, period), F.lit(0))


def frequency(period: Column) -> Column:
    return F.when(period.startswith("Q"), "Q").otherwise("M")


def is_year(value: Column) -> Column:
    """Whether a number can be a year."""
    return F.coalesce((value == F.floor(value)) & value.between(1990, 2100), F.lit(False))
