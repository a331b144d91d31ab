"""The text-quality pass over whole documents: certain issues, candidates for a verdict, and the report.

``docs(doc_id, text, ranges)`` as ``markers.split_pages`` gives them;
``dictionary(word)`` in lower case. Offsets are in characters, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.operators.markers import page_in
from factspan.operators.text import _TOKEN, STANDARD_FORMS

#: Characters shown on either side of a candidate.
AROUND = 60
#: Month names and abbreviations that a broken word may make.
MONTHS = [
    "januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember",
    "jan", "feb", "mar", "apr", "jun", "jul", "ags", "agu", "agt", "sep", "sept", "okt", "nov", "des",
]
#: Words of a dictionary that is broadcast; a larger one is joined by a shuffle.
BROADCAST = 2_000_000
CATEGORIES = ["ejaan", "tidak_baku", "grammar"]


def tokens(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, start, stop, word, nxt, third, gap_after, gap_beyond, nxt_stop)``: words with their places, the next two, and what stands after each.

    Whole texts are dealt by document first, so words are sorted where they are
    and never shuffled.
    """
    dealt = docs.select("doc_id", "text").repartition("doc_id")
    raw = dealt.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"[^A-Za-z]*{_TOKEN}"), F.lit(0))).alias("pos", "raw"))
    second = F.ascii(F.substr("raw", F.lit(2), F.lit(1)))
    one = F.startswith("raw", F.lit(" ")) & (second.between(65, 90) | second.between(97, 122))  # one blank, as nearly always
    t = raw.withColumn("gap", F.when(one, " ").otherwise(F.regexp_extract("raw", r"^[^A-Za-z]*", 0))).withColumn("word", F.substr("raw", F.length("gap") + 1))
    w = Window.partitionBy("doc_id").orderBy("pos")
    after = {"nxt": F.lead("word").over(w), "third": F.lead("word", 2).over(w), "gap_after": F.lead("gap").over(w), "gap_beyond": F.lead("gap", 2).over(w)}
    t = t.withColumns({"stop": F.sum(F.length("raw")).over(w).cast("int"), **after}).drop("raw", "gap")
    return t.withColumns({"start": F.col("stop") - F.length("word"), "nxt_stop": F.col("stop") + F.length("gap_after") + F.length("nxt")})


def _words(dictionary: DataFrame) -> DataFrame:
    """``(_form)``: the distinct words, to be broadcast unless they are too many; else the words of texts are shuffled to them."""
    words = dictionary.select(F.col("word").alias("_form")).distinct()
    return F.broadcast(words) if words.count() <= BROADCAST else words


def _with_known(t: DataFrame, made: Column, words: DataFrame, name: str) -> DataFrame:
    """Add whether ``made`` is one of ``words``; an equi-join."""
    return t.withColumn("_made", made).join(words, F.col("_made") == F.col("_form"), "left").withColumn(name, F.col("_form").isNotNull()).drop("_form", "_made")


def classified(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens that begin an issue or a candidate, with ``kind``: ``redup``, ``form``, ``prefix`` or ``word``.

    A token is taken by the first rule that holds: written twice; a
    non-standard form; ``di`` or ``ke`` apart from a word that it makes a known
    word with; in lower case, unknown, of two letters or more and with a vowel
    if of two, and no fragment. Rules for two tokens use up the second, so of
    neighbours for which they hold every other one counts. A fragment makes a
    known word or a month with one or two neighbours, one blank apart.
    """
    known = _words(dictionary)
    t = tokens(docs)
    lower = F.lower("word")
    one = F.coalesce(F.col("gap_after") == " ", F.lit(False))
    near = one | F.coalesce(F.col("gap_after").rlike(r"^\s+$"), F.lit(False))
    both = one & F.coalesce(F.col("gap_beyond") == " ", F.lit(False))
    t = t.withColumns({"two": F.when(near, F.lower(F.concat("word", "nxt"))), "three": F.when(both, F.lower(F.concat("word", "nxt", "third")))})
    t = _with_known(t, F.col("two"), known, "known_two")
    t = _with_known(t, F.col("three"), known, "known_three")
    month = lambda c: F.coalesce(F.col(c).isin(MONTHS), F.lit(False))
    twice = F.coalesce(near & (F.col("nxt") == lower) & ~F.contains("word", F.lit("-")) & (F.length("word") >= 3), F.lit(False))
    t = t.withColumns({"twice": twice, "form": lower.isin(list(STANDARD_FORMS)), "made_two": one & (F.col("known_two") | month("two")), "made_three": F.col("known_three") | month("three")})
    t = t.withColumn("pair", F.col("twice") | (~F.col("form") & lower.isin("di", "ke") & F.col("known_two"))).drop("two", "three", "known_two", "known_three")
    # of a run of pairs the first, third, ... begin one, and the token after each is used
    w = Window.partitionBy("doc_id").orderBy("pos")
    single = F.max(F.when(~F.col("pair"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    made = F.col("made_two") | F.lag("made_two", 1, False).over(w) | F.col("made_three") | F.lag("made_three", 1, False).over(w) | F.lag("made_three", 2, False).over(w)
    t = t.withColumns({"used": (F.col("pos") - 1 - F.coalesce(single, F.lit(-1))) % 2 == 1, "fragment": made}).where("not used")
    word = (F.col("word") == lower) & (F.length("word") >= 2) & ((F.length("word") > 2) | F.col("word").rlike("[aiueo]")) & ~F.col("fragment")
    kind = F.when(F.col("pair"), F.when(F.col("twice"), "redup").otherwise("prefix")).when(F.col("form"), "form").when(word, "word")
    t = t.withColumn("kind", kind).where("kind is not null")
    t = _with_known(t, F.when(F.col("kind") == "word", F.col("word")), known, "known").where("not known")
    return t.select("doc_id", "pos", "kind", "start", "stop", "word", "nxt", "nxt_stop")


def places(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(doc_id, kind, key, start, stop, word, hint, category, suggestion)``: certain issues and all places of candidates, in one pass.

    ``key`` and ``hint`` are of candidates, ``category`` and ``suggestion`` of
    certain issues.
    """
    c = classified(docs, dictionary)
    table = F.create_map(*[F.lit(x) for kv in STANDARD_FORMS.items() for x in kv])
    redup, form, prefix, word = (F.col("kind") == k for k in ("redup", "form", "prefix", "word"))
    two = redup | prefix
    return c.select(
        "doc_id", "kind", F.when(prefix, F.lower("nxt")).when(word, F.lower("word")).alias("key"), "start", F.when(two, F.col("nxt_stop")).otherwise(F.col("stop")).alias("stop"),
        F.when(two, F.concat_ws(" ", "word", "nxt")).otherwise(F.col("word")).alias("word"), F.when(prefix, F.lower(F.concat("word", "nxt"))).alias("hint"),
        F.when(redup, "grammar").when(form, "tidak_baku").alias("category"), F.when(redup, F.concat_ws("-", "word", "nxt")).when(form, table[F.lower("word")]).alias("suggestion"),
    )


def issues_and_candidates(docs: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certain issues ``(doc_id, start, stop, word, category, suggestion)``, and candidates.

    Candidates ``(doc_id, kind, key, display, context, hint, occurrences)`` are
    one for each word or prefixed word of a document, with all places where it
    stands and the text around the first.
    """
    p = places(docs, dictionary)
    sure = p.where("category is not null").select("doc_id", "start", "stop", "word", "category", "suggestion")
    g = p.where("category is null").groupBy("doc_id", "kind", "key").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "word", "hint"))).alias("occurrences"))
    first = F.get("occurrences", F.lit(0))
    lo = F.greatest(first["start"] - AROUND, F.lit(0))
    cands = g.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "kind", "key", first["word"].alias("display"), F.substr("text", lo + 1, first["stop"] + AROUND - lo).alias("context"), first["hint"].alias("hint"), F.transform("occurrences", lambda o: F.struct(o["start"].alias("start"), o["stop"].alias("stop"), o["word"].alias("word"))).alias("occurrences"))
    return sure, cands


def report(docs: DataFrame, dictionary: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Issues ``(doc_id, start, stop, word, category, suggestion, explanation, page)``; order by ``start`` to show them.

    ``verdicts(doc_id, kind, key, is_issue, category, suggestion, explanation)``
    hold for every place of a candidate; one without a category or suggestion,
    and a candidate without a verdict, gives no issue.
    """
    sure, cands = issues_and_candidates(docs, dictionary)
    every = sure.withColumn("explanation", F.lit(""))
    if verdicts is not None:
        fine = verdicts.where("is_issue and category <> '' and suggestion <> ''").select("doc_id", "kind", "key", "category", "suggestion", F.coalesce("explanation", F.lit("")).alias("explanation"))
        told = cands.join(fine, ["doc_id", "kind", "key"]).select("doc_id", F.explode("occurrences").alias("o"), "category", "suggestion", "explanation")
        every = every.unionByName(told.select("doc_id", "o.start", "o.stop", "o.word", "category", "suggestion", "explanation"))
    return every.join(docs.select("doc_id", "ranges"), "doc_id").withColumn("page", page_in(F.col("ranges"), F.col("start"))).drop("ranges")


def counts(issues: DataFrame) -> DataFrame:
    """``(doc_id, total, ejaan, tidak_baku, grammar)`` of documents with issues."""
    return issues.groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
