"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, lines that state a copyright dropped, every run
of ASCII characters other than letters and digits one blank, equivalent spellings made one. The SHA-256
of that form is looked up by a hash join among the digests of known licence texts, taken the same way.
Whole documents are looked up, and every whole line, so that a notice inside a document is found too.
Nothing is matched by parts or by likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import table, text_of
from attestry.llm.licence_texts import KNOWN

#: Spellings that licence matching holds to be the same.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("behaviour", "behavior"),
    ("cancelled", "canceled"),
    ("centre", "center"),
    ("colour", "color"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("https", "http"),
]
#: A line that states a copyright by a sign or a year; sentences that speak of one stay, however they are wrapped.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*((copyright[^\n]*?(\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*|all rights reserved[^a-z0-9\n]*)"
#: Everything of ASCII but letters, digits and line feeds.
OTHERS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"
ANY_SPELLING = r"[ \n](" + "|".join(said for said, _ in SPELLINGS) + r")[ \n]"


def canonical_lines(text: Column) -> Column:
    """A text's lines, each in the form whose digest is compared; a line that only states a copyright, or has no
    words, is empty. Spellings are replaced as whole words; one test first spares most texts the replacements."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1"), OTHERS, " ")
    framed = F.concat(F.lit("\n"), bare, F.lit("\n"))
    # Words stand apart by two blanks each, so that neighbours are both seen.
    apart = F.concat(F.lit(" "), F.replace(F.replace(bare, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for said, meant in SPELLINGS:
        apart = F.replace(apart, F.lit(f" {said} "), F.lit(f" {meant} "))
    return F.transform(F.split(F.when(framed.rlike(ANY_SPELLING), F.replace(apart, F.lit("  "), F.lit(" "))).otherwise(bare), "\n"), lambda line: F.trim(line))


def joined(lines: Column) -> Column:
    """The canonical form of a whole text from its lines'."""
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def builtin(spark) -> DataFrame:
    """The licences that come with this module, as a table (licence, text)."""
    return spark.createDataFrame(KNOWN, "licence string, text string")


def known_digests(licences: DataFrame) -> DataFrame:
    """(known, licence) of a table (licence, text): a text that comes out empty is no
    licence, and of several licences with one digest the first by name is kept."""
    canon = licences.select("licence", joined(canonical_lines(text_of())).alias("_canon")).where(F.length("_canon") > 0)
    return canon.groupBy(F.sha2("_canon", 256).alias("known")).agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the digest of its whole text, the licence that text is
    (or null), the licences that whole lines of it are, sorted and distinct (empty: none), and the
    number of such lines.

    A null text is the empty one and no licence; a null doc_id is an id like others. Repeated rows are
    each answered; an empty table gives no rows; other columns are not read. Texts never move: the
    licences are joined to them, a broadcast as long as Spark finds that table small, and only digests of whole
    texts and lines that match are grouped."""
    known = known_digests(licences)
    canon = docs.select("doc_id", F.sha2(text_of(), 256).alias("_same"), canonical_lines(text_of()).alias("_lines"))
    # Each text is brought to its form once: place 0 is the whole, then come its lines.
    forms = canon.select("doc_id", "_same", F.posexplode(F.concat(F.array(joined(F.col("_lines"))), F.col("_lines"))).alias("_at", "_form"))
    looked = forms.where((F.col("_at") == 0) | (F.col("_form") != "")).select("doc_id", "_same", "_at", F.sha2("_form", 256).alias("known")).join(known, "known", "left")
    whole, line = F.col("_at") == 0, F.col("_at") > 0
    # Repeated rows give the same lines again: each line of a text counts once.
    found = looked.where(whole | F.col("licence").isNotNull()).groupBy("doc_id", "_same").agg(
        F.sum(whole.cast("long")).alias("_rows"),
        F.max(F.when(whole, F.col("known"))).alias("digest"),
        F.max(F.when(whole, F.col("licence"))).alias("licence"),
        F.sort_array(F.collect_set(F.when(line, F.col("licence")))).alias("stated"),
        F.sum(line.cast("long")).alias("_stated"),
    )
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))
    return found.select("*", each.alias("_row")).select("doc_id", "digest", "licence", "stated", F.expr("_stated div _rows").alias("stated_lines"))


def op6_licences(spark, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"), builtin(spark))
    return found.withColumn("stated", F.array_join("stated", ","))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canon(source: str) -> str:
    """SQL: the columns of ``source`` without t, and the canonical form of t."""
    bare = f"trim(regexp_replace(regexp_replace(lower(t), '{COPYRIGHT_LINE}', '\\1', 'g'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'))"
    apart = "' ' || replace(b, ' ', '  ') || ' '"
    for said, meant in SPELLINGS:
        apart = f"replace({apart}, ' {said} ', ' {meant} ')"
    return f"SELECT * EXCLUDE (t, b), trim(replace({apart}, '  ', ' ')) AS canon FROM (SELECT *, {bare} AS b FROM ({source}))"


ORACLE = f"""
WITH licences(licence, t) AS (VALUES {", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in KNOWN)}),
known AS (SELECT sha256(canon) AS digest, min(licence) AS licence FROM ({_canon("SELECT licence, t FROM licences")}) WHERE canon <> '' GROUP BY 1),
whole AS (SELECT doc_id, sha256(canon) AS digest FROM ({_canon("SELECT doc_id, coalesce(text, '') AS t FROM documents")})),
lines AS (SELECT doc_id, sha256(canon) AS digest FROM ({_canon("SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents")})),
stated AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS stated, count(*) AS stated_lines FROM lines JOIN known USING (digest) GROUP BY 1)
SELECT w.doc_id, w.digest, k.licence, coalesce(s.stated, '') AS stated, coalesce(s.stated_lines, 0) AS stated_lines
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN stated s ON s.doc_id = w.doc_id
"""
