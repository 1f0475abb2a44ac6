"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line's shingles are the ``SHINGLE`` characters from every character on; a shorter line is one shingle. Every
distinct line gets a signature of ``BANDS * ROWS`` minima of their hashes, each under another permutation (the hash
with its bits turned round and some flipped). Lines that agree on all rows of a band are candidates: at the
threshold of 0.8 a pair meets with probability 1 - (1 - 0.8**ROWS)**BANDS, over 0.99.

A bucket of a band never puts out its pairs. Each member is verified against the bucket's head, the line with the most
copies, by exact Jaccard similarity; those that pass are in one component. Two members of which one fails can only
be alike where they differ from the head alike: similarity is a bound on the symmetric difference, and
that of two lines is what their differences from the head do not share. So members meet again by a shingle
that both have and the head lacks, or both lack and the head has, rare ones first, and only where enough of
their differences can still be shared from there on. No link that the bands find is lost, and variants of
a common line that differ in different words never meet. Links become components by a distributed union-find, and of
each component the first line by (doc_id, line number) stays.

Lines are compared as they stand, and equal ones are one from the start (by a 64-bit hash). Signatures
are taken where the documents are read; only they, keys and the texts of candidates are shuffled.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import drop_written, release_shuffles, text_of, written
from attestry.llm.components import components

SHINGLE = 12
BANDS, ROWS = 9, 3
#: Two lines are alike if SAME of OF shingles of their union are common.
SAME, OF = 4, 5
#: Shingles of a longer line that are cut at a time: to find a character takes a step for each before it.
LONG = 32
WINDOWS = rf"(?s)(?=(.{{{SHINGLE},{LONG + SHINGLE - 1}}})).{{1,{LONG}}}"


def _seeds(count: int, seed: int = 20_011) -> list[int]:
    rng = random.Random(seed)
    return [rng.getrandbits(62) for _ in range(count)]


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id, line_no, line, id): every line; key stands for the row, id for the line."""
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("key"))
    lines = rows.select("key", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("id", F.xxhash64("line"))


def said() -> Column:
    """Whether a line has anything but white space: blank lines stay and are never compared."""
    return F.length(F.trim(F.translate("line", "\t\r\x0b\x0c", "    "))) > 0


def windows(line: Column) -> Column:
    """Overlapping stretches that have a long line's shingles between them; other lines whole."""
    return F.when(F.length(line) >= LONG + SHINGLE, F.regexp_extract_all(line, F.lit(WINDOWS), F.lit(1))).otherwise(F.array(line))


def starts(window: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(window) - (SHINGLE - 1), F.lit(1)))


def shingle(window: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(window, start, F.lit(SHINGLE)))


def permuted(h: Column, number: int, seed: int) -> Column:
    """One of several bijections of 64-bit values: bits turned round, then flipped."""
    turn = 1 + 2 * number
    turned = F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn))
    return turned.bitwiseXOR(F.lit(seed))


def signatures(lines: DataFrame) -> DataFrame:
    """(id, copies, m0, m1, ...): how often each distinct line stands and the minima of its shingles' hashes, taken
    where the lines are read. Two minima are taken for equal by their upper 32 bits."""
    cut = lines.where(said()).select("id", F.posexplode(windows(F.col("line"))).alias("at", "w"))
    each = cut.select("id", "at", "w", F.explode(starts(F.col("w"))).alias("i"))
    hashes = each.select("id", ((F.col("at") == 0) & (F.col("i") == 1)).cast("int").alias("first"), shingle(F.col("w"), F.col("i")).alias("h"))
    minima = [F.min(F.shiftright(permuted(F.col("h"), j, seed), 32).cast("int")).alias(f"m{j}") for j, seed in enumerate(_seeds(BANDS * ROWS))]
    return hashes.groupBy("id").agg(F.sum("first").alias("copies"), *minima)


def shingle_set(line: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(windows(line), lambda w: F.transform(starts(w), lambda i: shingle(w, i)))))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def texts_of(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, line) of the lines in the pairs (a, b), written."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return written(lines.select("id", "line").join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")


def compared(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """(a, b, near, n, apart) of the pairs (a, b) of lines with texts ``of``: whether they are alike, how many
    shingles b has, and those that one has and the other lacks."""
    a, b = (of.select(F.col("id").alias(side), F.col("line").alias(f"line_{side}")) for side in "ab")
    both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", shingle_set(F.col("line_a")).alias("x"), shingle_set(F.col("line_b")).alias("y"))
    parts = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("n"), F.array_except("y", "x").alias("more"), F.array_except("x", "y").alias("less"))
    sized = parts.select("a", "b", "n", (F.col("nx") - F.size("less")).alias("common"), "nx", F.concat("more", "less").alias("apart"))
    near = F.col("common") * OF >= (F.col("nx") + F.col("n") - F.col("common")) * SAME
    return sized.select("a", "b", near.alias("near"), "n", "apart")


def meeting_again(checked: DataFrame) -> DataFrame:
    """(a, b): members of one head, one of which is unlike the head, that may be alike.

    Alike means |x ^ y| * (OF + SAME) <= (OF - SAME) * (|x| + |y|), and |x ^ y| = dx + dy - 2 |common differences|. With
    all differences in one order, the rarest of the head's members first, a pair's first common one has all the others
    behind it on both sides, and it is among the first n / 4 of either, or too few are left for any y."""
    others = checked.join(checked.where(~F.col("near")).select("a").distinct(), "a", "left_semi")
    each = others.select("a", "b", "near", "n", F.size("apart").alias("d"), F.explode("apart").alias("e"))
    held = each.groupBy("a", "e").agg(F.count("*").alias("held"))
    most = F.floor(F.col("n") * (OF - SAME) / SAME).cast("int") + 1
    ranked = each.join(held, ["a", "e"]).groupBy("a", "b", "near", "n", "d").agg(F.sort_array(F.collect_list(F.struct("held", "e"))).alias("apart"))
    ranked = written(ranked.withColumn("apart", F.slice("apart", 1, most)), "apart")

    def exploded(rows: DataFrame, side: str) -> DataFrame:
        placed = rows.select("a", F.col("b").alias(side), (~F.col("near")).alias(f"far_{side}"), F.col("n").alias(f"n_{side}"), F.col("d").alias(f"d_{side}"), F.posexplode("apart").alias(f"at_{side}", "common"))
        return placed.where("common.held > 1").select("*", "common.e").drop("common")

    c = F.col
    left = F.least(c("d_x") - c("at_x"), c("d_y") - c("at_y"))
    enough = (c("d_x") + c("d_y") - 2 * left) * (OF + SAME) <= (OF - SAME) * (c("n_x") + c("n_y"))
    once = F.when(c("far_y"), c("x.x") < c("y.y")).otherwise(c("x.x") != c("y.y"))
    x, y = exploded(ranked.where(~F.col("near")), "x").alias("x"), exploded(ranked, "y").alias("y")
    met = x.join(y, (c("x.a") == c("y.a")) & (c("x.e") == c("y.e")) & enough & once)
    return met.select(F.least("x.x", "y.y").alias("a"), F.greatest("x.x", "y.y").alias("b")).distinct()


def line_components(lines: DataFrame) -> DataFrame:
    """(id, component) of lines that are linked to a different line."""
    bands = [F.xxhash64(F.lit(band), *[F.col(f"m{band * ROWS + row}") for row in range(ROWS)]) for band in range(BANDS)]
    weight = F.shiftleft(F.least(F.col("copies").cast("long"), F.lit(1 << 20).cast("long")), 42).bitwiseOR(F.col("id").bitwiseAND(F.lit((1 << 42) - 1)))
    signed = written(signatures(lines).select("id", weight.alias("weight"), F.array(*bands).alias("bands")), "signatures")
    release_shuffles(lines.sparkSession)
    star = written(stars(signed), "star")
    texts = texts_of(star, lines)
    checked = written(compared(star, texts), "checked")
    for done in (signed, star, texts):
        drop_written(done)
    release_shuffles(lines.sparkSession)
    again = written(meeting_again(checked), "again")
    release_shuffles(lines.sparkSession)
    links = checked.where("near").select("a", "b").unionByName(compared(again, texts_of(again, lines)).where("near").select("a", "b"))
    return components(links, name="lines").withColumnRenamed("node", "id")


def stars(signed: DataFrame) -> DataFrame:
    """(a, b): the head and another member of a bucket of some band."""
    banded = signed.select("id", "weight", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.max_by("id", "weight").alias("head")).where(F.col("n") > 1).drop("n")
    members = banded.drop("weight").join(buckets, "band").where(F.col("id") != F.col("head"))
    return members.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(key, removed): the numbers of the lines of a row that repeat an earlier line."""
    lines = lines_of(docs)
    found = line_components(lines)
    seen = written(lines.where(said()).select("key", "doc_id", "line_no", "id"), "seen")
    label = seen.join(found, "id", "left").select("key", "doc_id", "line_no", F.coalesce("component", "id").alias("label"))
    label = written(label, "label")
    first = label.groupBy("label").agg(F.min(F.struct("doc_id", "key", "line_no")).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    again = label.join(first, "label").where((F.col("key") != F.col("first.key")) | (F.col("line_no") != F.col("first.line_no")))
    return again.groupBy("key").agg(F.collect_set("line_no").alias("removed"))


def answered(docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_removed): every row as one value, so its columns can have any names."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), text_of()).alias("key"))
    rows = keyed.join(removed_lines(docs), "key", "left")
    text = F.col("row")["text"]
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    left = F.array_join(F.transform(kept, lambda i: lines[i]), "\n")
    whole = F.col("removed").isNull() | text.isNull()
    return rows.select(
        "row",
        F.when(whole, text).otherwise(left).alias("text"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).alias("n_lines"),
        F.when(whole, F.lit(0)).otherwise(F.size("removed")).alias("n_removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the text its kept lines make, and n_lines and n_removed behind
    the other columns (columns of those names are replaced).

    Of every component of lines whose similarity reaches 0.8 the first stays, by doc_id (null first), then a
    hash of the text, then line number. Rows with equal doc_id and text are one document: they are
    answered alike. Lines without anything but white space stay. A null text stays null, with no lines; an
    empty table gives no rows; columns other than doc_id and text are handed on."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    done = answered(docs)
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns], "n_lines", "n_removed")


def op2_lines(docs: DataFrame) -> DataFrame:
    """Each document's numbers of lines and the digest of what stays of its text."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(text_of(), 256).alias("kept_sha256"))


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, and documents of which no line is left. Columns of any name
    are handed on as they are, but for text and, where there is one, n_chars. Nulls, blank lines and
    repeated rows as in ``dedup_lines``."""
    done = answered(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return done.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
