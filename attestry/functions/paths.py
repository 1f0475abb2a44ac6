"""Predicates and parts of repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension_of(path: Column) -> Column:
    """After the name's last dot, null where it has none."""
    name = file_name(path)
    return F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1))


def named_as_test(path: Column) -> Column:
    """A file any language's convention names a test."""
    return F.arrays_overlap(F.split(F.lower(file_name(path)), "[_.-]"), F.array(F.lit("test"), F.lit("spec")))


def beside_the_tests(path: Column) -> Column:
    lower = F.lower(path)
    top = F.get(F.split(lower, "/"), 0)
    return top.isin("test", "tests", "__tests__") | F.arrays_overlap(F.split(lower, "[/_.-]"), F.array(F.lit("test"), F.lit("spec")))


# Files that name a JavaScript package's dependencies.
DEPENDENCY_FILES = [
    "package.json", "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb",
]
def dependency_file(path: Column) -> Column:
    return file_name(path).isin(*DEPENDENCY_FILES)


def configuration_file(path: Column) -> Column:
    """A file that sets how tests or builds run."""
    name = F.lower(file_name(path))
    # Linter and formatter settings change nothing that runs.
    formatting = F.regexp_replace(name, r"^\.", "").rlike("^(eslint|prettier)")
    sets = (
        name.isin(".npmrc", "bunfig.toml") | (name.startswith("tsconfig") & name.endswith(".json"))
        | F.contains(name, F.lit(".config.")) | name.startswith(".babelrc.")
    )
    return sets & ~formatting


# Words that name a test kind, and directories that do as a whole name.
KIND_WORDS = {
    "unit": ["unit"],
    "component": ["component", "components", "ct"],
    "integration": ["integration", "int", "requests"],
    "e2e": ["e2e", "end-to-end", "offline", "online"],
}
KIND_DIRECTORIES = {"system": "e2e", "features": "e2e"}


def segment_kind(segment: Column) -> Column:
    """The kind a path segment names, by the word furthest into it; null for none."""
    spaced = F.regexp_replace(segment, "(?<=[a-z0-9])(?=[A-Z])", " ")
    flat = F.replace(F.lower(F.translate(spaced, "_.", "  ")), F.lit("end-to-end"), F.lit("end~to~end"))
    words = F.split(F.translate(flat, "-", " "), " ")

    def kind_of(word: Column) -> Column:
        bare = F.translate(word, "~", "-")
        found = F.lit(None).cast("string")
        for kind, names in KIND_WORDS.items():
            found = F.when(bare.isin(*names), kind).otherwise(found)
        return found

    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.array_compact(F.transform(words, kind_of))), -1)


def test_kind(path: Column, tags: Column) -> Column:
    """A test's kind: the first tag naming one, else the nearest directory that
    does, else the file's own name, else ``unit``."""
    bare = F.transform(tags, lambda tag: F.lower(F.regexp_replace(tag, "^@+", "")))
    tagged = F.get(F.filter(bare, lambda tag: tag.isin(*KIND_WORDS)), 0)
    parts = F.split(path, r"[/\\\\]")
    folders = F.reverse(F.slice(parts, 1, F.size(parts) - 1))

    def folder_kind(folder: Column) -> Column:
        named = F.lit(None).cast("string")
        for name, kind in KIND_DIRECTORIES.items():
            named = F.when(F.lower(folder) == name, kind).otherwise(named)
        return F.coalesce(named, segment_kind(folder))

    nearest = F.get(F.array_compact(F.transform(folders, folder_kind)), 0)
    return F.coalesce(tagged, nearest, segment_kind(F.element_at(parts, -1)), F.lit("unit"))
