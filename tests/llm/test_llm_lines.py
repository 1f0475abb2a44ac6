"""Fuzzy line dedup against the shingles of every character, taken independently of the operator."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

from helpers import every_shingle, near_lines  # noqa: E402

from attestry.llm import linededup  # noqa: E402


def test_no_character_is_left_out_of_the_comparison(spark):
    rng = np.random.default_rng(4)
    run = "".join(chr(97 + c) for c in rng.integers(26, size=300))
    lines = [
        "https://a.com/x1", "https://a.com/x2", "- configuration_option_a", "- configuration_option_b", "1234567890123", "1234567890124", "short", "shorter", "\U0001f600 wide \U0001f601",
        run, run[:5] + "+" + run[5:], run[:150] + "?" + run[151:], "k" * 30 + run[:40], "k" * 30 + run[40:80], "漢字" * 9, "漢字" * 9 + "\r",
    ]
    long = "".join(chr(97 + c) for c in rng.integers(26, size=24_581))
    lines += [long, long[:8192] + "-" + long[8192:], long[::-1]]
    label, seen, kept = near_lines(lines, every_shingle, 0.8), set(), []
    for i, c in enumerate(label):
        if c not in seen:
            kept.append(i)
        seen.add(c)
    assert 8 < len(kept) < len(lines)
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.n_removed == 0) == kept


def test_variants_of_a_common_line_keep_their_links_and_do_not_multiply(spark):
    rng = np.random.default_rng(7)
    words = [f"word{i:02d}" for i in range(14)]
    lines = [" ".join(words)] * 40
    for i in range(400):
        changed = list(words)
        changed[rng.integers(14)] = f"new{rng.integers(10**6):06d}"
        lines.append(" ".join(changed))
        if i % 5 == 0:
            lines.append(" ".join(changed) + "!")
        if i % 7 == 0:
            changed[rng.integers(14)] = f"old{i:04d}"
            lines.append(" ".join(changed))
    label, seen, kept = near_lines(list(dict.fromkeys(lines)), every_shingle, 0.8), set(), []
    place = {x: n for n, x in enumerate(dict.fromkeys(lines))}
    for i, x in enumerate(lines):
        if label[place[x]] not in seen:
            kept.append(i)
        seen.add(label[place[x]])
    assert len(kept) > 20
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = linededup.dedup_lines(frame).collect()
    assert sorted(r.doc_id for r in got if r.n_removed == 0) == kept
    # Pairs of variants that meet are few beside all of them.
    texts = linededup.lines_of(frame).groupBy("id", "line").count().select("id", "line")
    star = texts.selectExpr("id as b").crossJoin(texts.where(f"line = '{lines[0]}'").selectExpr("id as a")).where("a <> b")
    checked = linededup.compared(star, texts).cache()
    assert checked.where("not near").count() > 100
    assert linededup.meeting_again(checked).count() < 4 * checked.count()


def test_what_is_done_with_leaves_the_shared_folder(spark):
    from pathlib import Path

    from attestry.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    lines = [f"a line of some words number {i % 9} and {i % 5}" for i in range(60)]
    linededup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    left = {p.name.split("-")[1] for p in folder.iterdir() if p.name not in before}
    assert "checked" in left and not left & {"signatures", "star"}
