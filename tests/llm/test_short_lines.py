"""Line dedup of short lines, against a brute force that knows nothing of the module."""

import random
import re
from collections import defaultdict

from ledgerlight.llm import linededup

BLANKS = " \r\n\t"


def removed(rows):
    """doc_id -> text without the later occurrences of three-line windows."""
    lines = {d: [x for x in re.split(r"(?<=[.!?] )|(?<=\n)", t) if x.strip(BLANKS)] for d, t in rows}
    seen, gone = set(), defaultdict(set)
    for d, _ in sorted(rows):
        ls = [x.strip(BLANKS) for x in lines[d]]
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if w in seen:
                gone[d].update((i, i + 1, i + 2))
            seen.add(w)
    return {d: "".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) if gone[d] else t for d, t in rows}


def test_windows_of_few_characters_are_compared(spark):
    short = "Yes. No! Go. Why? Stop. "
    shout = "BUY\nNOW\nWIN\nBIG\n"
    rows = [(1, f"{short}One doc ends here.\n"), (2, f"Another begins.\n{short}It ends otherwise.\n"), (3, f"{shout}first tail"), (4, f"head\n{shout}last tail"), (5, "a\nb\n"), (6, "a\nb\n"), (7, "x\n" * 6)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed(rows)
    assert got[2] == "Another begins.\nIt ends otherwise.\n" and got[4] == "head\nlast tail" and got[6] == "a\nb\n"


def test_passages_without_marks_fall_into_step(spark):
    r = random.Random(3)
    words = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('bdglmnprsty')}" for _ in range(300)]
    passage = " ".join(words)
    rows = [(1, f"one two three {passage} tail of one"), (2, f"one two three four five {passage} tail of two"), (3, f"A sentence. {' '.join(words[:120])}")]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1]
    assert len(got[2].text.split()) < 60 and len(got[3].text.split()) < 60


def test_columns_of_any_name(spark):
    rows = [(1, "a b.\nc d.\ne f.\n", 9, 8, 7, 6, 5), (2, "a b.\nc d.\ne f.\nlast.\n", 4, 3, 2, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, doc int, part int, gone int, row int")
    left = linededup.rewrite(df)
    assert left.columns == df.columns
    assert sorted(tuple(x) for x in left.collect()) == [rows[0], (2, "last.\n", 4, 3, 2, 1, 0)]
    assert {x.doc_id: x.n_removed for x in linededup.dedup_lines(df).collect()} == {1: 0, 2: 3}
