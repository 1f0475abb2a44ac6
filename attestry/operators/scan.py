"""Source lines worth asking a security check about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as words
from attestry.functions.needles import CATALOGUE
from attestry.functions.paths import extension_of
from attestry.operators import ordered

CANDIDATE_CAP = 120
NODE_CAP = 300


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """A file's numbered lines, a carriage return before the break left out."""
    split = F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n")
    kept = [name for name in files.columns if name != text]
    return files.select(*kept, F.posexplode(split).alias("line", text)).withColumn("line", F.col("line") + 1)


def source_lines(files: DataFrame) -> DataFrame:
    """Numbered lines that are no comment."""
    return lines(files).filter(~words.is_comment(F.col("text")))


def candidate_lines(files: DataFrame, catalogue: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, line, check) for every check one of whose needles a line holds,
    and for lines that assign a secret. A line is scanned once per check, inside
    one projection: no lines-by-needles join is made."""
    found = [F.when(words.holds_any(F.col("text"), parts), F.lit(check)) for check, parts in (catalogue or CATALOGUE).items()]
    found.append(F.when(words.secret_assignment(F.col("text")), F.lit("secret_in_source")))
    shown = F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, 160)
    return source_lines(files).select("path", "line", shown.alias("text"), F.explode(F.array_compact(F.array(*found))).alias("check"))


def round_robin(candidates: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """At most ``cap`` candidates per file, one of each check in turn.

    Both ranks are kept below a constant, so partitions are cut to it before the
    shuffle and a file holding a third of all lines stays small."""
    turn = F.row_number().over(Window.partitionBy("path", "check").orderBy("line", "text"))
    dealt = candidates.withColumn("_turn", turn).filter(F.col("_turn") <= cap)
    place = F.row_number().over(Window.partitionBy("path").orderBy("_turn", "check"))
    return dealt.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_turn", "_place")


def spread(nodes: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    """At most ``cap`` nodes per file, evenly over its lines, one per line."""
    first = nodes.groupBy("path", "line").agg(F.min("text").alias("text"))
    placed = ordered.row_numbers(first, ["path"], "line", [F.col("line")], "_n").withColumn("_i", F.col("_n") - 1)
    sizes = first.groupBy("path").agg(F.count(F.lit(1)).alias("_size"))
    step = F.col("_size") / cap
    guess = F.floor(F.col("_i") / step)

    def hit(i):
        return (i < cap) & (F.floor(i * step) == F.col("_i"))

    kept = (F.col("_size") <= cap) | hit(guess) | hit(guess + 1)
    return placed.join(sizes, "path").filter(kept).drop("_n", "_i", "_size")


def template_nodes(files: DataFrame) -> DataFrame:
    """Lines of templates and configuration files worth asking about."""
    read = lines(files.filter(words.security_extra(F.col("path")))).withColumn("extension", extension_of(F.col("path")))
    kept = read.filter(words.template_or_config_line(F.col("extension"), F.col("text")))
    return kept.select("path", "line", F.substring(F.trim("text"), 1, 160).alias("text"))


# The endings a script import is tried with, in this order.
SCRIPT_ENDINGS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"]


def folded(path: Column) -> Column:
    """A path without ``.`` parts, each ``..`` taking the part before it; at the root
    it takes none."""
    none = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"), none,
        lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part))))
    return F.array_join(parts, "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file an import names: (file, specifier, target), for imports that name one.

    A relative script import is the path itself, else ending by ending the file
    with it and the folder's index with it. A Python import walks up by its leading dots
    (without any it starts at the root) and is the longest part of the dotted name that is a
    module or a package. The first that exists counts; in Python a file that would import
    itself is passed over, in a script it means none."""
    python = F.col("file").endswith(".py")
    folder = F.regexp_replace("file", "[^/]*$", "")
    script = F.concat(folder, F.col("specifier"))
    scripts = F.array(script, *[F.concat(script, F.lit(form)) for e in SCRIPT_ENDINGS for form in (f".{e}", f"/index.{e}")])
    dots = F.length(F.regexp_extract("specifier", r"^\.*", 0))
    names = F.filter(F.split(F.expr("substring(specifier, length(regexp_extract(specifier, '^[.]*', 0)) + 1)"), r"\."), lambda p: p != "")
    depth = F.size(F.split(folder, "/")) - 1
    start = F.when(dots == 0, F.lit("")).otherwise(F.concat(folder, F.array_join(F.array_repeat(F.lit("../"), dots - 1), "")))
    cuts = F.filter(F.sequence(F.size(names), F.lit(0), F.lit(-1)), lambda n: n > 0)
    modules = F.flatten(F.transform(cuts, lambda n: F.transform(
        F.array(F.lit(".py"), F.lit("/__init__.py")), lambda end: F.concat(start, F.array_join(F.slice(names, 1, n), "/"), end))))
    # Climbing above the root names nothing.
    forms = F.when(python, F.when(dots - 1 <= depth, modules)).when(F.col("specifier").startswith("."), scripts)
    tried = imports.select("file", "specifier", F.posexplode(forms).alias("_rank", "_form")).select("file", "specifier", "_rank", folded(F.col("_form")).alias("target"))
    known = files.select(F.col("path").alias("target")).distinct()
    found = tried.join(known, "target").filter(~python | (F.col("target") != F.col("file")))
    return found.groupBy("file", "specifier").agg(F.min_by("target", "_rank").alias("target")).filter("target <> file")
