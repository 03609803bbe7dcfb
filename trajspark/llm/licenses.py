"""Licence scans by canonical digest lookup. DataFrame operations only.

A text is brought to a canonical form (lower case, without copyright lines, one spelling of words with several, only
ASCII letters and digits with single blanks), and the digest of the entire form is joined with the digests of known
licences. The same is done with each single line, for licence notices. The known licences are a constant table of a
few dozen rows, which is broadcast.

Defined results: null and empty texts, and those with nothing left of them, match nothing. Every row of the input is
looked up, so repeated rows repeat their matches; rows without an id keep a null id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import LICENSES, SPELLINGS

COPYRIGHT_LINES = r"(?m)^[ \t#*/-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
OTHER = r"[^a-z0-9]+"


def apart(words: str) -> str:
    return words.replace(" ", "  ")


def canonical(text: Column) -> Column:
    x = F.regexp_replace(F.lower(text), COPYRIGHT_LINES, " ")
    # two blanks between words: each has its own on both sides, so neighbours that are spelled alike are both replaced
    x = F.concat(F.lit(" "), F.regexp_replace(x, OTHER, "  "), F.lit(" "))
    for spelling, standard in SPELLINGS.items():
        x = F.replace(x, F.lit(f" {apart(spelling)} "), F.lit(f" {standard} "))
    return F.trim(x)


def known_licenses(spark, licenses: dict[str, str] = LICENSES) -> DataFrame:
    """(license_id, digest): one row for each known text."""
    rows = spark.createDataFrame([*licenses.items()], "license_id string, text string")
    return rows.select("license_id", F.md5(canonical(F.col("text"))).alias("digest"))


def find_licenses(
    docs: DataFrame, licenses: dict[str, str] = LICENSES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, license_id, scope, line): scope 'text' if the entire text is the licence, 'line' if a line of it is.

    line: number of the line from 0; null for entire texts. A text of one line gives both.
    """
    whole = docs.select(id_col, F.lit("text").alias("scope"), F.lit(None).cast("int").alias("line"), F.col(text_col).alias("part"))
    lines = docs.select(id_col, F.lit("line").alias("scope"), F.posexplode(F.split(text_col, "\n")).alias("line", "part"))
    parts = whole.unionByName(lines.select(id_col, "scope", "line", "part"))
    digests = parts.select(id_col, "scope", "line", F.md5(canonical(F.col("part"))).alias("digest"))
    found = digests.join(F.broadcast(known_licenses(docs.sparkSession, licenses)), "digest")
    return found.select(id_col, "license_id", "scope", "line")


def oracle_sql(licenses: dict[str, str] = LICENSES) -> str:
    """find_licenses over documents, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        x = f"regexp_replace(lower({text}), {quote(COPYRIGHT_LINES)}, ' ', 'g')"
        x = f"(' ' || regexp_replace({x}, {quote(OTHER)}, '  ', 'g') || ' ')"
        for spelling, standard in SPELLINGS.items():
            x = f"replace({x}, {quote(f' {apart(spelling)} ')}, {quote(f' {standard} ')})"
        return f"md5(trim({x}))"

    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in licenses.items())
    return f"""
with known as (select license_id, {form("text")} as digest from (values {known}) as k(license_id, text)),
     parts as (
       select doc_id, 'text' as scope, cast(null as integer) as line, text as part from documents
       union all
       select doc_id, 'line', cast(n - 1 as integer), l
       from (select doc_id, unnest(string_split(text, chr(10))) as l,
                    generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
     )
select doc_id, license_id, scope, line
from (select *, {form("part")} as digest from parts) p join known using (digest)
"""
