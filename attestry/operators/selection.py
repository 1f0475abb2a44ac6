"""Test filters and selectors, and the errors they raise when nothing matches."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NoMatch(ValueError):
    """A filter or selector that matches nothing: an error, not an empty answer."""


class Ambiguous(ValueError):
    """A selector that matches more than one thing."""

    def __init__(self, what: str, candidates: list[str]):
        super().__init__(f"{what} matches {', '.join(candidates)}")
        self.candidates = candidates


def _either(terms: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, terms)


def picks(values: list[str], matches) -> Column:
    """One wanted value matches and no ``!excluded`` one does."""
    wanted = [value for value in values if not value.startswith("!")]
    excluded = [value[1:] for value in values if value.startswith("!")]
    condition = _either([matches(value) for value in wanted]) if wanted else F.lit(True)
    return condition & ~_either([matches(value) for value in excluded]) if excluded else condition


@dataclass(frozen=True)
class TestFilter:
    """Criteria a test must all meet, each by one of its values."""

    tags: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    kind: str | None = None
    runner: str | None = None

    def condition(self) -> Column:
        def tagged(wanted: str) -> Column:
            return F.exists("tags", lambda carried: F.lower(F.regexp_replace(carried, "^@+", "")) == wanted.lstrip("@").lower())

        def titled(wanted: str) -> Column:
            text = F.lit(wanted.lower())
            return F.contains(F.lower("name"), text) | F.contains(F.lower(F.coalesce("title", F.lit(""))), text)

        def filed(wanted: str) -> Column:
            path = wanted
            while path.startswith("./"):
                path = path[2:]
            path = path.rstrip("/")
            bare = F.regexp_replace(F.coalesce("test_file", F.lit("")), r"^(\./)+", "")
            return F.col("test_file").isNotNull() & ((bare == path) | bare.startswith(path + "/"))

        kept = picks(self.tags, tagged) & picks(self.titles, titled) & picks(self.files, filed)
        if self.kind is not None:
            kept = kept & (F.col("kind") == self.kind)
        if self.runner is not None:
            kept = kept & (F.col("runner") == self.runner)
        return kept


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Refuse an empty selection; one row at most reaches the driver."""
    if df.isEmpty():
        raise NoMatch(f"no test matches {what}")
    return df


def picked_tests(tests: DataFrame, criteria: TestFilter) -> DataFrame:
    return tests.filter((F.col("role") == "test") & criteria.condition())


def with_setup(tests: DataFrame, picked: DataFrame) -> DataFrame:
    """Picked tests and the setup of their files; background work is no test's."""
    files = picked.select("run_id", "test_file").distinct()
    setup = tests.filter("role = 'setup'").join(files, ["run_id", "test_file"], "left_semi")
    return picked.unionByName(setup)


def setup_expansion(tests: DataFrame, chosen: DataFrame) -> DataFrame:
    """What runs when the chosen tests do: they, background work, their files' setup."""
    background = tests.filter("role = 'background'")
    return with_setup(tests, chosen).unionByName(background).dropDuplicates(["run_id", "test_id"])


def select_tests(tests: DataFrame, selector: str) -> DataFrame:
    """Tests by exact id, else by a part of their name in any case. ``exact``
    says which; every match of the better sort is returned, per run."""
    exact = tests.filter(F.col("test_id") == selector).withColumn("exact", F.lit(True))
    by_name = tests.filter(F.contains(F.lower("name"), F.lit(selector.lower()))).withColumn("exact", F.lit(False))
    return exact.unionByName(by_name.join(exact.select("run_id"), "run_id", "left_anti"))


def select_decisions(decisions: DataFrame, selector: str) -> DataFrame:
    """Decisions by id, else by ``file:line`` or ``file:line:column``."""
    import re

    place = re.fullmatch(r"(.+?):(\d+)(?::(\d+))?", selector)
    condition = F.col("id") == selector
    if place:
        at = (F.col("file") == place[1]) & (F.col("line") == int(place[2]))
        if place[3]:
            at = at & (F.col("col") == int(place[3]))
        condition = condition | at
    return decisions.filter(condition)


def select_source_file(files: DataFrame, selector: str) -> str:
    """An exact path, else the one path holding the text; names the candidates otherwise."""
    found = (
        files.select("file").distinct().filter(F.contains("file", F.lit(selector)))
        .orderBy(F.desc(F.col("file") == selector), "file")
    )
    first = [row.file for row in found.take(2)]
    if not first:
        raise NoMatch(f"no source file matches {selector}")
    if first[0] != selector and len(first) > 1:
        raise Ambiguous(selector, [row.file for row in found.toLocalIterator()])
    return first[0]


# Which obligation kinds a metric asks for.
METRIC_KINDS = {
    "lines": ["line"],
    "statements": ["statement"],
    "functions": ["function"],
    "branches": ["branch"],
    "mcdc": ["condition"],
    "all": ["line", "statement", "function", "branch", "condition"],
}


def of_metric(kind: Column, metric: str) -> Column:
    if metric not in METRIC_KINDS:
        raise ValueError(f"unknown metric {metric!r}")
    return kind.isin(*METRIC_KINDS[metric])
