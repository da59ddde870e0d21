"""Line dedup: overlapping three-line windows, found globally.

A line is a piece of text up to a newline or the end of a sentence. Longer ones are cut
by their content: from the word after ``LEAST_WORDS`` on, a line also ends with a word
whose last letter is in ``CUT_LETTERS``, so that a paragraph without marks, stored on one
physical line, falls into step with its copies whatever stands before it; ``MOST_WORDS`` words
end a line that has no such word. Three consecutive lines that are
not blank make a window, named by two 64-bit hashes of its trimmed lines. Windows
that occur more than once keep their first occurrence, in order of (doc_id,
position); the lines covered by later ones are merged and removed.

Aggregates carry only longs, so counts combine before the shuffle; a very
frequent window is one row per task there, and the join back to its occurrences is a
plain equi-join whose large partitions AQE may split.

Rows are named by 128 bits of (doc_id, text), a missing doc_id apart from every present one, so
that rows are told apart however many share a doc_id or have none.

Edge cases: null, empty and blank texts, and texts of under three lines, have no
window and stay as they are; every other window is compared, however short. Rows that share doc_id and text are one document seen
twice and get the same result. A document that loses nothing keeps its text byte for
byte; in others the kept lines keep their own separators. Null doc_ids come
first; texts of one doc_id, or of none, come in the order of their names. Extra columns are kept by ``dedup_lines`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored

LEAST_WORDS, MOST_WORDS = 6, 22
CUT_LETTERS = "dglmruy"
WINDOW = 3
#: A sentence ends with a mark, which one quote or bracket may follow.
GOES_ON = r"[^ \n]*+(?<![.!?…])(?<![.!?…][\"'”’»)\]])"
#: Words that end no line, then the word that does; nothing backtracks.
LINE = rf"(?:{GOES_ON} ){{0,{LEAST_WORDS}}}+(?:{GOES_ON}(?<![{CUT_LETTERS}]) ){{0,{MOST_WORDS - LEAST_WORDS - 1}}}+[^ \n]*+(?: |\n|\z)"
BLANKS = " \r\n\t"


def lines(text: Column) -> Column:
    """All lines with their separators; joined they are the text again."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINE), F.lit(0)), lambda x: x != "")


def _name(doc_id: Column, text: Column) -> list[Column]:
    """(t1, t2): 128 bits that name a row by its doc_id, or the lack of one, and its text."""
    parts = (doc_id, doc_id.isNull(), text)
    return [F.xxhash64(*parts).alias("t1"), F.xxhash64(F.lit(7), *parts).alias("t2")]


def window_rows(docs: DataFrame) -> DataFrame:
    """doc, t1, t2, i, h1, h2: every window of every document."""
    raw = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(LINE), F.lit(0))
    spoken = F.filter(F.transform(raw, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    # A line is hashed once; a window hashes its lines' hashes. No filter on the number of
    # lines: it would be pushed below this projection and cut every text a second time.
    hashed = F.transform(spoken, lambda x: F.xxhash64(x))
    n = F.size("l")
    lanes = F.arrays_zip(*[F.slice("l", i + 1, F.greatest(n - (WINDOW - 1), F.lit(0))).alias(f"l{i}") for i in range(WINDOW)])
    lane = [F.col(f"w.l{i}") for i in range(WINDOW)]
    rows = docs.select(F.col("doc_id").alias("doc"), *_name(F.col("doc_id"), F.col("text")), hashed.alias("l")).select("doc", "t1", "t2", F.posexplode(lanes).alias("i", "w"))
    return rows.select("doc", "t1", "t2", "i", F.xxhash64(*lane).alias("h1"), F.xxhash64(F.lit(7), *lane).alias("h2"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """t1, t2, gone: sorted positions, among non-blank lines, that are removed."""
    w = stored(window_rows(docs), "line-windows")  # used twice
    # Tables that are joined are written first: only plain shuffles have skewed partitions split.
    often = stored(w.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "often")
    place = ["doc", "t1", "t2", "i"]  # null doc_ids come first in a struct's order
    seen = stored(w.join(often, "h1").select("h1", "h2", *place), "repeated")
    first = stored(seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first")).where("n > 1").select("h1", "h2", "first"), "first")
    later = seen.join(first, ["h1", "h2"]).where(F.struct(*place) > F.col("first"))
    covered = later.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("i")).alias("starts"))
    merged = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + (WINDOW - 1))))))
    return covered.select("t1", "t2", merged.alias("gone"))


def _marked(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs``), text (rewritten) and n_removed: no name of ``docs`` can clash."""
    gone = removed_lines(docs.select("doc_id", "text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_name(F.col("doc_id"), F.col("text")))
    j = rows.join(gone.hint("shuffle_hash"), ["t1", "t2"], "left")
    ls = F.filter(lines(F.col("row.text")), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    # The lines leave through a generator, so that they are cut once and not for each kept one; the kept
    # positions are a set difference, linear in the lines of a text.
    j = j.select("row", "gone", F.inline(F.array(F.struct(F.when(F.col("gone").isNotNull(), ls).alias("ls")))))
    left = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("ls", i)), "")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return j.select("row", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rewritten, plus n_removed (long), in place of a column of that name. Only texts that lose lines are cut up again."""
    names = [c for c in docs.columns if c not in ("text", "n_removed")]
    return _marked(docs).select(*[F.col(f"row.`{c}`") for c in names], "text", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_chars_left and text_md5 of the rewritten text."""
    d = dedup_lines(docs.select("doc_id", "text"))
    body = F.coalesce("text", F.lit(""))
    return d.select("doc_id", "n_removed", F.length(body).cast("bigint").alias("n_chars_left"), F.md5(body).alias("text_md5"))


def rewrite(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines removed; rows that lose every line go, n_chars follows the text."""
    d = _marked(docs)
    changed = F.col("n_removed") > 0
    d = d.where(~(changed & (F.btrim("text", F.lit(BLANKS)) == "")))
    of = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in of:
        of["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(of["n_chars"])
    return d.select(*[x.alias(c) for c, x in of.items()])
