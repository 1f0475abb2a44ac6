"""Predicates and words of source lines, names and literals."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import needles
from attestry.functions.paths import extension_of, file_name, folder_of


def holds_any(text: Column, parts: list[str]) -> Column:
    """Whether the text holds one of the parts. Plain substring searches, which
    stop at the first found, are several times an alternation's speed."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(part)) for part in parts])


def is_comment(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^\s+", "")
    return (bare == "") | reduce(lambda a, b: a | b, [bare.startswith(mark) for mark in ("#", "//", "*", "/*")])


def secretish(value: Column) -> Column:
    """A literal that would grant access if copied."""
    prefixed = value.rlike("^(" + "|".join(re.escape(p) for p in needles.KEY_PREFIXES) + ")")
    hexed = (F.octet_length(value) >= 20) & value.rlike(r"^[0-9a-fA-F]+$")
    base64 = (
        (F.octet_length(value) >= 24) & value.rlike(r"^[A-Za-z0-9+/_-]*=*$")
        & value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
    )
    worded = holds_any(F.lower(value), ["password", "secret", "passwd"])
    return (F.octet_length(value) >= 8) & (prefixed | hexed | base64 | worded)


def secret_assignment(line: Column) -> Column:
    """``name = "..."`` where the name says credential and the value is long enough."""
    lower = F.lower(line)
    name = F.regexp_extract(lower, r"^([^=:]*)[=:]", 1)
    return lower.rlike("[=:]") & holds_any(name, needles.SECRET_NAMES) & lower.rlike(r"""^[^=:]*[=:]\s*['"`][^'"`]{6,}['"`]""")


def name_words(text: Column) -> Column:
    """Words of a name or a line: camelCase split, lowercased, filler and short ones out."""
    # Words that say nothing of what a test is about.
    filler = ["test", "tests", "the", "and", "for", "with", "get", "set", "self", "from", "not", "does", "should"]
    apart = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    words = F.split(F.lower(apart), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*filler)))


def split_words(text: Column) -> Column:
    """Words of an identifier: camel and snake case split, single letters out."""
    apart = F.regexp_replace(text, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 1)


def path_words(path: Column) -> Column:
    stem = F.get(F.split(F.element_at(F.split(path, r"[/\\]"), -1), r"\."), 0)
    return F.array_distinct(F.filter(split_words(stem), lambda w: ~w.isin("test", "tests", "spec", "specs")))


def test_words(file: Column, name: Column) -> Column:
    own = F.get(F.split(F.element_at(F.split(name, "[#:>./]"), -1), r"[\[(]"), 0)
    return F.array_distinct(F.concat(path_words(file), split_words(own)))


def name_match(file: Column, name: Column, changed_words: Column) -> Column:
    """How many of the changed files' words a test's file or name shares."""
    return F.size(F.array_intersect(test_words(file, name), changed_words))


IDENTIFIER = r"[\p{L}\p{N}_]+"


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def names_word(text: Column, word: Column) -> Column:
    """Whether the text holds the word as a whole identifier."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.rlike(text, quoted)


def _without_braces(body: Column) -> Column:
    """Every outermost pair of braces, however deep it nests, as one mark; an opening
    brace that is never closed parts the text like a mark."""
    empty = F.array(F.lit(""))

    def read(stack: Column, part: Column) -> Column:
        top, below = F.element_at(stack, -1), F.slice(stack, 1, F.size(stack) - 1)
        inner = F.element_at(below, -1)
        closed = F.concat(F.slice(below, 1, F.size(below) - 1), F.array(F.concat(inner, F.lit("\u0001"))))
        told = F.concat(below, F.array(F.concat(top, part)))
        return F.when(part == "{", F.concat(stack, empty)).when((part == "}") & (F.size(stack) > 1), closed).otherwise(told)

    return F.array_join(F.aggregate(F.split(body, "(?=[{}])|(?<=[{}])"), empty, read), "\u0001")


def quoted_fragments(text: Column) -> Column:
    """The fixed parts of a text's string literals, six bytes or longer with three letters."""
    literal = r"""'((?:[^'\\]|\\[\s\S])*)'|"((?:[^"\\]|\\[\s\S])*)"|`((?:[^`\\]|\\[\s\S])*)`"""
    whole = F.regexp_extract_all(text, F.lit(literal), F.lit(0))
    bodies = F.transform(whole, lambda x: _without_braces(F.substring(x, F.lit(2), F.length(x) - 2)))
    pieces = F.flatten(F.transform(bodies, lambda x: F.split(x, "[\u0001$#%{]")))
    trimmed = F.transform(pieces, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(trimmed, lambda x: (F.octet_length(x) >= 6) & (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 3))
    return F.array_sort(F.array_distinct(kept))


def stem(path: Column) -> Column:
    return F.lower(F.get(F.split(file_name(path), r"\."), 0))


def describe(name: Column, separator: str) -> Column:
    """A test's name without its last part."""
    parts = F.split(name, re.escape(separator))
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), separator)


def estimated_tokens(text: Column) -> Column:
    """A third of the bytes, but runs of 64 and more base64-like characters whole."""
    dense = F.aggregate(
        F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/=_-]{64,}"), F.lit(0)), F.lit(0), lambda acc, run: acc + F.octet_length(run))
    return (F.ceil((F.octet_length(text) - dense) / 3) + dense).cast("long")


def stable_id(*parts: Column) -> Column:
    """Twelve bytes of SHA-256 over parts each ended by a zero byte, in hex."""
    ended = F.concat(*[F.concat(part, F.lit("\u0000")) for part in parts])
    return F.substring(F.sha2(ended.cast("binary"), 256), 1, 24)


def xml_escape(value: Column) -> Column:
    """Escape for XML text and attributes, dropping what XML 1.0 cannot carry."""
    bare = F.regexp_replace(value, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), pairs, bare)


def json_configuration(path: Column) -> Column:
    lower = F.lower(path)
    parts = F.split(F.regexp_replace(file_name(lower), r"\.json$", ""), "[._-]")
    named = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in needles.CONFIG_NAMES]))
    placed = F.arrays_overlap(F.split(folder_of(lower), "/"), F.array(*[F.lit(n) for n in needles.CONFIG_DIRECTORIES]))
    return named | placed


def security_extra(path: Column) -> Column:
    """A template or configuration file the security scan reads beside source."""
    name, extension = file_name(path), extension_of(path)
    manifest = (
        name.endswith(".lock") | name.isin("package-lock.json", "package.json", "composer.json")
        | name.startswith("tsconfig") | name.startswith("jsconfig") | name.endswith(".min.js")
    )
    wanted = F.when(extension == "json", json_configuration(path)).otherwise(
        extension.isin(*needles.TEMPLATE_EXTENSIONS, *needles.CONFIG_EXTENSIONS))
    return F.coalesce(~manifest & wanted, F.lit(False))


def _head(text: Column, size: int) -> Column:
    """The first bytes of a text, a character cut in two left out."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, size).cast("string")), "�+$", "")


def minified(text: Column) -> Column:
    """Lines over 500 bytes hold more than half of a head over 2,000 bytes."""
    head = _head(text, 65_536)
    long = F.aggregate(
        F.split(head, "\r?\n"), F.lit(0), lambda acc, line: acc + F.when(F.octet_length(line) > 500, F.octet_length(line)).otherwise(0))
    return (F.octet_length(head) > 2000) & (long * 2 > F.octet_length(head))


def third_party(path: Column, text: Column) -> Column:
    """Why a JavaScript file is someone else's or a machine's; null where it is not."""
    lower = F.lower(path)
    name = file_name(lower)
    script = name.rlike(r"\.(js|mjs|cjs)$")
    served = F.arrays_overlap(F.split(folder_of(lower), "/"), F.array(*[F.lit(d) for d in needles.SERVED_DIRECTORIES]))
    licensed = holds_any(_head(text, 2048), needles.BANNERS)
    named = name.rlike("(^|[._-])(" + "|".join(re.escape(lib) for lib in needles.LIBRARIES) + ")[._-]")
    return F.when(script & minified(text), "minified code").when(script & served & (licensed | named), "vendored third-party library")


def template_or_config_line(extension: Column, line: Column) -> Column:
    """Whether a line of a template or configuration file is worth asking about."""
    bare = F.trim(line)
    told = (bare != "") & ~bare.startswith("#") & ~bare.startswith("//")
    template = holds_any(bare, needles.TEMPLATE_MARKS) & ~bare.startswith("<!--")
    return told & F.when(extension.isin(*needles.TEMPLATE_EXTENSIONS), template).otherwise(bare.rlike("[:=]"))


def answer_key(*question: Column) -> Column:
    """The key an answer to a question is kept and reused under."""
    return F.sha2(F.to_json(F.struct(*[part.alias(f"q{i}") for i, part in enumerate(question)])), 256)
