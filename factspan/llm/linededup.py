"""Line dedup by an exact set-similarity join, in DataFrame operations only.

Lines are told apart by a hash of their words, so equal lines are one from the
start; the words of lines that share a hash are compared, and all is done again
with another hash should they differ. A line is the set of its word shingles.
Shingles are ordered by the least rank among the first words of the grams (three
words in a row) that they hold, long words first. Two lines that are similar
enough share a shingle in their prefixes, and with it the gram of that word, so
a gram stands for several neighbouring shingles and only grams of prefixes are
posted; posted tokens that no other line has are dropped. Candidates pass
length and bitmap filters and a comparison of shingle sets, each line
first against the earliest line of its tokens, and only the lines that stay open
against the others: a group of similar lines is not spelt out in pairs. Hashes
of 64 bits only filter: the words themselves, which are fetched for repeated
lines and candidates only, decide whether lines are equal or similar.
"""

from __future__ import annotations

from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factspan.llm.tables import discard, fresh, release, settled, written

SHINGLE = 5
PERCENT = 80
#: Words that begin at one of the places that a line posts; a shingle holds several such grams, and its neighbours the same ones.
GRAM = 3
#: Words of as many bytes or more come first in the order, shorter ones by their size.
LONG = 15
#: A line is compared with the earliest line of each of its tokens, then with this many of each hot token, then with all.
EARLIEST = 16
#: Tokens with more lines than this are hot.
HOT = 64
#: Parts of a token's postings that are ranked on their own first.
PARTS = 32
#: Ids that are broadcast to fetch their rows; more are joined by a shuffle.
BROADCAST = 1_000_000
_FIRST_ID = -(1 << 63)
#: Whether small partitions are kept apart for the cores there are.
_PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def _doc(doc_id: str) -> Column:
    """A document's place in the order: its id, or for a null one a place before all others."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST_ID))


def _plain(text: Column) -> Column:
    """Lower case, with blanks for other ASCII white space than line feeds."""
    plain = F.lower(text)
    for c in "\t\r\f\x0b":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return plain


def _tidy(line: str) -> Column:
    """A plain line with its words joined by single blanks."""
    ragged = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(ragged, F.array_join(F.array_remove(F.split(line, " "), ""), " ")).otherwise(F.col(line))


def _tidied(docs: DataFrame, doc_id: str, text: str, salt: int = 0) -> DataFrame:
    """``(doc, row, no, line, k)``: a row's key, a line's place, its words joined by blanks, and their hash."""
    texts = docs.select(_doc(doc_id).alias("doc"), F.xxhash64(text).alias("row"), _plain(F.col(text)).alias("plain"))
    lines = texts.select("doc", "row", F.posexplode(F.split("plain", "\n")).alias("no", "raw")).where(F.trim("raw") != "")
    return lines.select("doc", "row", "no", _tidy("raw").alias("line")).withColumn("k", F.xxhash64(F.lit(salt), "line"))


def _rank(word: Column, i: Column) -> Column:
    """A word's rank over its place ``i`` (32 bits): long words, which tend to be rare, come first, then by hash."""
    spare = (F.lit(LONG) - F.least(F.octet_length(word), F.lit(LONG))).cast("long") * F.lit(1 << 59)
    return spare + F.xxhash64(word).bitwiseAND(F.lit((1 << 59) - (1 << 32))) + i.cast("long")


def _grams(n: int) -> Column:
    """The hashes of each ``n`` words in a row of ``words``, which alone is named, as a column named once would be computed again for each."""
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    return F.transform(places, lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(n)]))


def _tokens(n: int) -> Column:
    """The hashes of the distinct shingles of ``words``, ``n`` words at least, in order."""
    return F.sort_array(F.array_distinct(_grams(n)))


def _ranked(lines: DataFrame, *keep: str) -> DataFrame:
    words = lines.select(*keep, F.split("line", " ").alias("words"))
    return words.select(*keep, "words", F.transform("words", _rank).alias("r"))


def _lines(docs: DataFrame, doc_id: str, text: str, salt: int = 0) -> DataFrame:
    """``(k, words, r)``: lines by the hash of their words, their words, and the ranks of these."""
    return _ranked(_tidied(docs, doc_id, text, salt), "k")


def _covered(places: str, size: str, reach: int) -> Column:
    """Of ``size`` shingles, how many begin at one of ``places`` (sorted, from 1) or less than ``reach`` before."""
    high, low = F.lit(1 << 32), F.lit((1 << 32) - 1)  # the sum over the last place
    step = lambda x, i: x + (F.least(i, size) - F.greatest(x.bitwiseAND(low), i - reach)) * high + F.least(i, size) - x.bitwiseAND(low)
    return F.shiftright(F.aggregate(places, F.lit(0).cast("long"), step), 32)


def _posts(lines: DataFrame, n: int, percent: int, *keep: str) -> DataFrame:
    """``(*keep, k, token)``: a row for each line with null ``token``, and one with null ``keep`` for each gram that it posts.

    A shingle counts as the least rank of the words that begin a gram in it.
    The ``limit`` of a line is a rank that more of its shingles are within than
    a similar line can lack, so of the shingles that two similar lines share,
    the one that counts least is within the limits of both, and both post its
    gram. Shingles that hold the first place of one of the least ranks of a line
    are all different, as that place is at another offset or has another rank;
    where too few are found by these, all grams are posted. Lines of fewer words
    than a shingle's are similar to equal ones only.
    """
    g = min(GRAM, n)
    reach = n - g + 1
    at, place = F.col("i"), F.lit((1 << 32) - 1)
    size = F.size("words") - n + 1
    prefix = lambda m: m - F.floor((m * percent + 99) / 100).cast("int") + 1
    lines = lines.select(*keep, "k", "words", "r", size.cast("long").alias("size"), F.when(size > 0, prefix(size)).alias("need"))
    lines = lines.withColumn("few", F.ceil(F.col("need") * 5 / (4 * reach)).cast("int") + 1)
    least = F.slice(F.sort_array(F.slice("r", F.lit(1), F.col("size").cast("int") + reach - 1)), F.lit(1), F.col("few"))
    lines = lines.withColumn("least", F.when(F.col("need").isNotNull(), least))
    rank = lambda x: F.shiftright(x, 32)
    firsts = F.filter("least", lambda x, j: (j == 0) | (rank(x) != rank(F.get("least", j - 1))))
    lines = lines.withColumn("spots", F.sort_array(F.transform(firsts, lambda x: x.bitwiseAND(place) + 1)))
    limit = F.when(_covered("spots", "size", reach) >= F.col("need"), F.get("least", F.size("least") - 1).bitwiseOR(place))
    lines = lines.select(*keep, "k", "words", "r", "need", limit.alias("limit"))
    lines = lines.withColumn("every", F.when(F.col("need").isNotNull() & F.col("limit").isNull(), F.array_distinct(_grams(g))))
    last = F.when(F.col("need").isNull(), -1).when(F.col("every").isNotNull(), F.size("every") - 1).otherwise(F.size("words") - g)
    spread = lines.select(*keep, "k", "words", "r", "limit", "every", F.explode(F.sequence(F.lit(-1), last)).alias("i"))
    posted = spread.where((at < 0) | F.col("every").isNotNull() | (F.get("r", at) <= F.col("limit")))
    gram = F.when(F.col("every").isNotNull(), F.get("every", at)).otherwise(F.xxhash64(*[F.get("words", at + j) for j in range(g)]))
    return posted.select(*[F.when(at < 0, F.col(c)).alias(c) for c in keep], "k", F.when(at >= 0, gram).alias("token"))


def _few(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for a broadcast where it is not long."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def _shared(posts: DataFrame) -> DataFrame:
    """The distinct posts whose token a line of other words has too; ends combine before the shuffle, and the join splits a hot token."""
    several = written(posts.groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("token"), "several")
    out = written(posts.join(_few(several), "token").select("token", F.col("k").alias("id")).distinct(), "shared")
    discard(several)
    return out


def _parity(half: int) -> Column:
    """64 bits: for each bit, whether an odd number of ``tokens`` falls on it; two halves make 128."""
    own = lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1)) if half else F.lit(1) - F.shiftright(t, 6).bitwiseAND(F.lit(1))
    bit = lambda t: F.call_function("shiftleft", own(t).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(bit(t)))


def _fits(percent: int) -> Column:
    """Length and bitmap filters on a pair (``n``, ``b0``, ``b1`` and the same with ``f``).

    Sets that are similar enough differ in few tokens, and bits of their
    parities that differ are at most as many.
    """
    total = F.col("n") + F.col("fn")
    length = 100 * F.least("n", "fn") >= percent * F.greatest("n", "fn")
    apart = F.bit_count(F.col("b0").bitwiseXOR(F.col("fb0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("fb1")))
    return length & ((100 + percent) * apart <= (100 - percent) * total)


def _enough(x: Column, y: Column, percent: int) -> Column:
    """Whether 100 * shared >= percent * (all - shared), with one intersection, as conditions compute a part for each time it is named."""
    return (100 + percent) * F.size(F.array_intersect(x, y)).cast("long") >= percent * (F.size(x).cast("long") + F.size(y))


def _spelt(words: str, n: int) -> Column:
    """The distinct shingles of ``words`` as text; no word holds a blank."""
    spelt = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, F.array_distinct(spelt)).otherwise(F.array(F.array_join(words, " ")))


def _similar(pairs: DataFrame, spelling: DataFrame, n: int, percent: int) -> DataFrame:
    """Of distinct pairs ``(id, fid)``, the later lines (of ids ``id``) that are similar to the earlier one, by their words."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select("id").unionByName(pairs.select(F.col("fid").alias("id"))).distinct(), "ids")
    sets = spelling.join(_few(ids), "id", "left_semi").select("id", "line", F.split("line", " ").alias("words"))
    sets = written(sets.select("id", "line", _tokens(n).alias("tokens")), "tokens")
    a = sets.select("id", F.col("tokens").alias("x"))
    b = sets.select(F.col("id").alias("fid"), F.col("tokens").alias("y"))
    likely = pairs.join(a, "id").join(b, "fid").where(_enough(F.col("x"), F.col("y"), percent)).select("id", "fid")
    a = sets.select("id", F.split("line", " ").alias("x"))
    b = sets.select(F.col("id").alias("fid"), F.split("line", " ").alias("y"))
    both = likely.join(a, "id").join(b, "fid")
    fine = F.transform(F.array(F.struct(_spelt("x", n).alias("x"), _spelt("y", n).alias("y"))), lambda p: _enough(p["x"], p["y"], percent))
    out = written(both.where(F.get(fine, 0)).select("id").distinct(), "found")
    discard(pairs, ids, sets)
    return out


def _texts(lines: DataFrame, slim: DataFrame, shared: DataFrame) -> DataFrame:
    """``(id, line, at, same, near, clash)`` of the hashes that several lines have (``same``) or that have posts (``near``).

    ``at`` is the earliest place; ``clash`` says that lines of other words have the hash too.
    """
    same = slim.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k", F.lit(True).alias("same"), F.lit(False).alias("near"))
    near = shared.select(F.col("id").alias("k")).distinct().select("k", F.lit(False).alias("same"), F.lit(True).alias("near"))
    wanted = written(same.unionByName(near).groupBy("k").agg(F.max("same").alias("same"), F.max("near").alias("near")), "wanted")
    found = lines.select("doc", "no", "line", "k").join(_few(wanted), "k")
    least = found.groupBy("k", "same", "near").agg(F.min("line").alias("line"), F.max("line").alias("other"), F.min(F.struct("doc", "no")).alias("at"))
    out = written(least.select(F.col("k").alias("id"), "line", "at", "same", "near", (F.col("line") != F.col("other")).alias("clash")), "texts")
    discard(wanted)
    return out


@contextmanager
def _few_files(spark: SparkSession):
    """Small shuffles end in few tasks, as each file an executor writes may start a process or two."""
    before = spark.conf.get(_PARALLEL, None)
    spark.conf.set(_PARALLEL, "false")
    try:
        yield
    finally:
        spark.conf.unset(_PARALLEL) if before is None else spark.conf.set(_PARALLEL, before)


def repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc, row, dropped array<int>)``: places from 0 of the lines of a row that an earlier line repeats.

    ``doc`` is the id (the least long for a null one) and ``row`` is
    ``xxhash64(text)``. Lines are separated by a line feed; earlier is by
    document id (null first), then place. A line goes when its words equal
    those of an earlier line, or when the Jaccard similarity of its distinct
    shingles of ``shingle`` words with those of some earlier line, kept or not,
    is at least ``percent`` / 100; fewer words are one shingle. Words are
    lower-cased and stand between blanks, tabs and other ASCII white space.
    Lines without words, null and empty texts lose nothing. Rows that repeat an
    id and text are one row here. Rows that lose nothing are not returned.
    """
    with _few_files(docs.sparkSession):
        return _repeated(docs, doc_id, text, shingle, percent)


def _repeated(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    for salt in count():
        lines = _tidied(docs, doc_id, text, salt)
        posts = written(_posts(_ranked(lines, "doc", "row", "no", "k"), shingle, percent, "doc", "row", "no"), "posts")
        slim = posts.where("token is null").select("doc", "row", "no", "k")
        shared = _shared(posts.where("token is not null"))
        texts = _texts(lines, slim, shared)
        if texts.where("clash").isEmpty():
            break
        discard(posts, shared, texts)  # lines of other words with the same hash: again, with another hash
    sets = texts.where("near").select("id", "at", F.split("line", " ").alias("words"))
    sets = sets.select("id", "at.doc", "at.no", _tokens(shingle).alias("tokens"))
    sets = written(sets.select("id", "doc", "no", F.size("tokens").alias("n"), _parity(0).alias("b0"), _parity(1).alias("b1")), "sets")
    release(spark)

    names = ["doc", "no", "id", "n", "b0", "b1"]
    spots = written(shared.join(sets, "id").select("token", *names), "spots")
    discard(shared)
    hot = written(spots.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("token"), "hot")
    some_hot = not hot.isEmpty()
    later = (F.col("doc") > F.col("fdoc")) | ((F.col("doc") == F.col("fdoc")) & (F.col("no") > F.col("fno")))

    def earliest(high: int) -> DataFrame:
        """The earliest lines of each token; parts of a token are ranked first, so none is ranked whole."""
        if high == 1:
            return spots.groupBy("token").agg(F.min(F.struct(*names)).alias("f")).select("token", "f.*")
        part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part")
        out = spots.join(hot, "token", "left_semi").select("*", part)
        for by in (["token", "part"], ["token"]):
            rank = F.row_number().over(Window.partitionBy(*by).orderBy("doc", "no", "id"))
            out = out.withColumn("rank", rank).where(F.col("rank") <= high).drop("rank")
        return out.drop("part")

    open_, lost, used = spots, None, []
    for high in (1, EARLIEST, None) if some_hot else (1, None):
        some = (earliest(high) if high else spots).select("token", *[F.col(c).alias(f"f{c}") for c in names])
        some = written(some, "earliest") if high else some
        pairs = open_.join(some, "token").where(later & _fits(percent)).select("id", "fid").distinct()
        found = _similar(pairs, texts, shingle, percent)
        used.append(found)
        lost = found if lost is None else lost.unionByName(found)
        if high:
            used.append(some)
            open_ = open_.join(found, "id", "left_anti")

    lost = written(lost.distinct().withColumn("gone", F.lit(True)), "lost")
    marks = texts.select("id", "at", "same").join(lost, "id", "left").where("same or gone")
    dropped = slim.join(marks.select(F.col("id").alias("k"), "at", "gone"), "k").where(F.col("gone") | (F.struct("doc", "no") > F.struct("at.doc", "at.no")))
    out = settled(dropped.groupBy("doc", "row").agg(F.sort_array(F.collect_set("no")).alias("dropped")))
    discard(posts, texts, sets, spots, hot, lost, *used)
    return out


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places from 0, by commas); one row for each row of ``docs``. A null text has no lines."""
    found = repeated_lines(docs, **options)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    base = docs.select("doc_id", _doc("doc_id").alias("doc"), F.xxhash64("text").alias("row"), lines.alias("lines"))
    out = base.join(found, ["doc", "row"], "left")
    return out.select("doc_id", F.col("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", emptied: bool = True, **options) -> DataFrame:
    """``docs`` without the lines that earlier lines repeat, with the columns of ``docs``.

    A row that loses all its words stays with what is left, or goes where
    ``emptied`` is false. Rows with null, empty or blank texts stay as they are,
    and repeated rows are treated alike.
    """
    doc, row, dropped = fresh(docs, "doc", "row", "dropped")
    found = repeated_lines(docs, doc_id=doc_id, text=text, **options).select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("dropped").alias(dropped))
    out = docs.withColumns({doc: _doc(doc_id), row: F.xxhash64(text)}).join(found, [doc, row], "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col(dropped), i)), "\n")
    out = out.withColumn(text, F.when(F.col(dropped).isNull(), F.col(text)).otherwise(left))
    if not emptied:
        out = out.where(F.col(dropped).isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*docs.columns)


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
           FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
w AS (SELECT doc_id, no, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM l),
u AS (SELECT min(row(doc_id, no)) AS pos, line, any_value(w) AS w FROM w WHERE len(w) > 0 GROUP BY line),
s AS (SELECT DISTINCT pos, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
      FROM (SELECT pos, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM u)),
c AS (SELECT pos, count(*) AS n FROM s GROUP BY pos),
p AS (SELECT x.pos AS a, y.pos AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.pos > y.pos GROUP BY ALL),
gone AS (SELECT DISTINCT a FROM p JOIN c x ON x.pos = a JOIN c y ON y.pos = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
d AS (SELECT doc_id, no FROM w JOIN u USING (line) WHERE pos < row(doc_id, no) OR pos IN (SELECT a FROM gone)),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS names FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(names, '') AS removed
FROM documents LEFT JOIN r USING (doc_id)
"""
