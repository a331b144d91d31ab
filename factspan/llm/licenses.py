"""License scans by canonical digest lookup.

A text is normalised (case, punctuation, copyright lines, equivalent
spellings), digested, and joined to the digests of known licences, whole text
against whole text. The lines of a text are looked up the same way, each as a
text of its own, for the one-line notices that name a licence.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.llm.tables import fresh, without

#: Equivalent spellings of the licence-matching guidelines, applied in this order.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("&", " and "),
]
COPYRIGHT_LINE = "(^|\n)[ \t]*(copyright|\\(c\\)|©)[^\n]*"
PUNCTUATION = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F©‘’“”–—]+"

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."

#: Whole licence texts by identifier.
LICENSES = {
    "MIT": f"MIT License\n\nCopyright (c)\n\n{_GRANT}{_NO_WARRANTY}",
    "MIT-untitled": f"Copyright (c)\n\n{_GRANT}{_NO_WARRANTY}",
    "ISC": "ISC License\n\nCopyright (c)\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Zero-Clause BSD\n\nCopyright (C)\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "zlib License\n\n(C)\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}

#: Texts of common licences, one file for each identifier.
TEXTS = Path(__file__).parent / "license_texts"
_END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """``(license, text)`` of the whole texts that are known.

    A text with an appendix after its terms stands without it as well, and the
    three-clause BSD text with any holder's wording, with and without its last clause.
    """
    out = list(LICENSES.items())
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        if name == "BSD-3-Clause-UC":
            name = "BSD-3-Clause"
            head, rest = text.split("3. ")
            clause, rest = rest.split("\n\n", 1)
            plain = rest.replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
            head = "\n".join(x for x in head.split("\n") if x.strip() != "All rights reserved.")
            for kind, title, body in (
                ("BSD-3-Clause", "BSD 3-Clause License", f"{head}3. {clause.replace('University', 'copyright holder')}\n\n{plain}"),
                ("BSD-2-Clause", "BSD 2-Clause License", f"{head}\n{plain}"),
            ):
                rights = body.replace("Redistribution and use", "All rights reserved.\n\nRedistribution and use", 1)
                out += [(kind, t) for b in (body, rights) for t in (b, f"{title}\n\n{b}")]
        out.append((name, text))
        if _END in text:
            out.append((name, text[: text.index(_END) + len(_END)]))
    return out


#: One-line notices and the licence each names.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "All rights reserved.": "proprietary",
}


def normal(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, and single blanks for white space and punctuation."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, PUNCTUATION, " "))


def digest(text: Column) -> Column:
    return F.sha2(normal(text).cast("binary"), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """``(known, license)``: digests of named texts. Equal digests keep the first name."""
    rows = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(texts)], "name string, text string, ord int")
    return rows.select(digest(F.col("text")).alias("known"), "name", "ord").groupBy("known").agg(F.min_by("name", "ord").alias("license"))


def license_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license, n_notices, notices; one row for each row of ``docs``.

    ``license`` is the known licence that the whole text is, else null;
    ``notices`` the distinct licences its lines name, sorted and joined by
    commas, and ``n_notices`` how many lines do. A null text has a null digest;
    an empty one, or one of copyright lines only, the digest of nothing.
    """
    spark = docs.sparkSession
    whole = known_digests(spark, whole_texts())
    lines = known_digests(spark, [(n, n) for n in NOTICES])
    name = F.create_map(*[F.lit(x) for kv in NOTICES.items() for x in kv])
    table = dict(lines.select("known", name[F.col("license")].alias("license")).collect())  # as many as NOTICES
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    longest = spark.createDataFrame([(n,) for n in NOTICES], "name string").agg(F.max(F.length(normal(F.col("name"))))).first()[0]
    plain = F.filter(F.transform(F.split(text, "\n"), normal), lambda x: F.length(x) <= longest)
    found = F.filter(F.transform(plain, lambda x: lookup[F.sha2(x.cast("binary"), 256)]), lambda x: x.isNotNull())
    base = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    return base.join(F.broadcast(whole), base.digest == whole.known, "left").select(
        "doc_id", "digest", "license", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices")
    )


def with_license(docs: DataFrame, *, text: str = "text", license: str = "license") -> DataFrame:
    """``docs`` with the identifier of the licence that its whole text is, or null.

    A null or empty text has none; every row stays; a column called ``license`` is replaced.
    """
    docs = without(docs, text, license)
    key, known = fresh(docs, "digest", "known")
    whole = known_digests(docs.sparkSession, whole_texts()).select(F.col("known").alias(known), F.col("license").alias(license))
    return docs.withColumn(key, digest(F.col(text))).join(F.broadcast(whole), F.col(key) == F.col(known), "left").drop(key, known)


def _sql_normal(x: str) -> str:
    t = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE.replace(chr(10), chr(92) + 'n').replace(chr(9), chr(92) + 't')}', '\\1', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace({t}, '{PUNCTUATION}', ' ', 'g'), ' ')"


def _sql_values(texts: list[tuple[str, str]]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({quote(k)}, {quote(v)}, {i})" for i, (k, v) in enumerate(texts)) + ") AS t(name, text, ord)"


ORACLE_SQL = f"""
WITH whole AS (SELECT sha256({_sql_normal('text')}) AS digest, arg_min(name, ord) AS license FROM {_sql_values(whole_texts())} GROUP BY 1),
notice AS (SELECT sha256({_sql_normal('name')}) AS digest, text AS license FROM {_sql_values(list(NOTICES.items()))}),
d AS (SELECT doc_id, sha256({_sql_normal('text')}) AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
      FROM l JOIN notice ON sha256({_sql_normal('line')}) = notice.digest GROUP BY doc_id)
SELECT d.doc_id, d.digest, license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notices
FROM d LEFT JOIN whole USING (digest) LEFT JOIN f USING (doc_id)
"""
