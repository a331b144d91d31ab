"""Label normalisation and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factspan.functions.core import let

#: Separates a qualifier from its member in a label.
QUALIFIER = " > "

#: Words of titles and queries that name no subject.
TITLE_STOP_WORDS = [
    "dan", "di", "ke", "dari", "untuk", "yang", "pada", "atau", "dalam", "dengan", "oleh", "atas", "total", "jumlah", "posisi",
    "indonesia", "bank", "penghimpunan", "penyaluran", "pertumbuhan", "perkembangan", "tercatat", "the", "of", "a", "an", "and", "in", "for",
]
#: Words that say when, not what.
PERIOD_WORDS = [
    "januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember",
    "jan", "feb", "mar", "apr", "jun", "jul", "agu", "ags", "sep", "okt", "nov", "des",
    "january", "february", "march", "june", "july", "august", "october", "december",
    "triwulan", "kuartal", "semester", "tahun", "bulan", "yoy",
]
#: Other words a title may use for a query's word.
SUBJECT_SYNONYMS = {"dpk": ["simpanan", "dana", "pihak", "ketiga"]}
#: Names of rows that hold a table's total.
TOTAL_ROWS = ["total", "jumlah"]


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def significant_words(text: Column) -> Column:
    """The distinct lower-case words of three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), F.lit(1)), lambda w: F.length(w) > 2))


def canonical(text: Column) -> Column:
    """Lower case, white space collapsed, none beside punctuation."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"(?U)\s+", " "), r"(?U)\s*([^\w\s])\s*", "$1")


def squeezed(text: Column) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def alphanumeric(text: Column) -> Column:
    """Only the letters a-z and digits, lower-cased."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def dice(a: Column, b: Column) -> Column:
    """Dice overlap of two word sets; 0 when either is empty."""
    both = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def label_score(query: Column, label: Column) -> Column:
    """How well a label answers a query, from 0 to 1."""
    return dice(significant_words(query), significant_words(label))


def leaf(label: Column) -> Column:
    """What follows the last qualifier, or the whole label."""
    return F.element_at(F.split(label, QUALIFIER), -1)


def is_qualified(label: Column) -> Column:
    return F.contains(label, F.lit(QUALIFIER))


def qualifier_kept(query: Column, label: Column) -> Column:
    """Whether a label keeps at least half the words of a qualified query's member."""
    words = significant_words(leaf(query))
    kept = let(words, lambda w: (F.size(w) == 0) | (2 * F.size(F.array_intersect(w, significant_words(label))) >= F.size(w)))
    return ~is_qualified(query) | kept


def query_is_about(query: Column, label: Column, title: Column) -> Column:
    """Whether the words a query adds to a label are explained by the title, or the label covers half of the query."""
    words = F.filter(F.array_except(significant_words(query), _words(TITLE_STOP_WORDS + PERIOD_WORDS)), lambda w: ~w.rlike(r"^\d+$"))

    def rule(w: Column) -> Column:
        covered = F.array_intersect(w, significant_words(label))
        rest = F.array_except(F.array_except(w, covered), significant_words(F.coalesce(title, F.lit(""))))
        return (F.size(w) == 0) | (F.size(rest) == 0) | (2 * F.size(covered) >= F.size(w))

    return let(words, rule)


def subject_words(query: Column) -> Column:
    """The words that name a query's subject."""
    return F.array_except(significant_words(F.replace(F.lower(query), F.lit("dana pihak ketiga"), F.lit("dpk"))), _words(TITLE_STOP_WORDS))


def covered_words(title: Column) -> Column:
    """The words that a title covers: its own, and those it has a synonym of."""
    named = F.array_except(significant_words(F.coalesce(title, F.lit(""))), _words(TITLE_STOP_WORDS))
    more = [F.when(F.arrays_overlap(_words(v), named), F.array(F.lit(k))).otherwise(F.array().cast("array<string>")) for k, v in SUBJECT_SYNONYMS.items()]
    return F.array_distinct(F.concat(named, *more))


def query_names_subject(query: Column, title: Column) -> Column:
    """Whether a title covers every significant word of a query, synonyms included."""
    words = subject_words(query)
    return let(words, lambda w: (F.size(w) > 0) & (F.size(F.array_except(w, covered_words(title))) == 0)) & (F.coalesce(title, F.lit("")) != "")


def quote_names_member(label: Column, quote: Column) -> Column:
    """Whether a sentence names every significant word of a qualified label's member."""
    words = significant_words(leaf(label))
    return is_qualified(label) & let(words, lambda w: (F.size(w) > 0) & (F.size(F.array_except(w, significant_words(quote))) == 0))


def composite(parts: Column) -> Column:
    """Join label parts by the qualifier: squeezed, blanks dropped, repeats of the part before collapsed."""
    clean = F.filter(F.transform(parts, lambda p: squeezed(F.coalesce(p, F.lit("")))), lambda p: p != "")
    kept = let(clean, lambda a: F.filter(a, lambda p, i: (i == 0) | (F.lower(p) != F.lower(F.coalesce(F.get(a, i - 1), F.lit(""))))))
    return F.array_join(kept, QUALIFIER)


def is_marker(text: Column) -> Column:
    """Bullets and enumeration marks, which name nothing."""
    return F.trim(text).rlike(r"^(?:[\-–—•·*]+|(?:[A-Za-z]\d{0,2}|\d{1,2})[.)])$")
