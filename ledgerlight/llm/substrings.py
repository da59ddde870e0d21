"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller doc_id. It is kept as blocks: the
least hash among the ``SEED``-word runs inside a window of ``WINDOW`` words is the window's seed, and
a stretch of windows with one seed is a block. Where texts are alike their blocks are alike, whatever stands
before them, as seeds depend on nothing but the words. The index holds each distinct block (seed and a
hash of all its words: 128 bits) with the first place where it stands.

A document is parsed against the index of all blocks. A block known from a smaller doc_id
is copied whole; copied blocks whose references go on in the same document, at
the next place, are joined greedily into one factor. Factors end where the reference
doesn't go on: there a block holds some words of the copy and some others, and is in no index. So windows
at the boundaries are checked one by one: the windows of distinct blocks that share their seed with another
distinct block are hashed alone (128 bits) and looked up, and those known from a smaller
doc_id become factors of their own. Every factor has ``WINDOW`` words or more; all its words go.

Nothing is missed: equal windows have equal seeds, so they lie in equal blocks, or in distinct blocks
of one seed. Windows are judged on the input, not on what is left.

Only narrow rows move: seeds are counted with map-side combine and those of one row are dropped;
tables that are joined are written first, so that only plain shuffles meet and AQE can split
a hot seed or block. Copies fall together into one distinct block before their windows are looked at. Words are
hashed in pieces of bounded size; one text is held at a time.

Edge cases: null, empty and short texts (under ``WINDOW`` words) lose nothing; a null doc_id
is smaller than all others, and rows of one doc_id, or without, take nothing from each other; rows that
share doc_id and text get the same result. ``dedup`` gives a text that loses words its kept words joined by one space and
leaves every other as it is. Extra columns are kept by ``dedup`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, tune
from ledgerlight.llm.shingles import mix, powers

WINDOW, SEED = 13, 6
#: A block of a text that says one thing over and over ends after so many windows.
MOST = 64
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_ZERO = np.zeros(0, dtype=np.uint64)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    edge = np.ones(n + 2, dtype=bool)
    edge[1:-1] = _SPACES[raw]
    flips = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = flips[::2], flips[1::2]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, letters as they are."""
    raw, parts, at = np.frombuffer(text, dtype=np.uint8), [_ZERO], 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):  # a piece ends before a separator
            cut = np.flatnonzero(_SPACES[raw[at:end]])
            if len(cut) and cut[-1]:
                end = at + int(cut[-1])
            else:
                later = np.flatnonzero(_SPACES[raw[end:]])
                end = end + int(later[0]) if len(later) else len(raw)
        parts.append(_piece_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


class Text:
    """Hashes of the word runs of one text."""

    def __init__(self, text: str | None):
        self.words = word_hashes((text or "").encode())
        self.n = len(self.words)
        self.windows = max(0, self.n - WINDOW + 1)
        self._sums: dict[int, np.ndarray] = {}

    def runs(self, at: np.ndarray, size: np.ndarray | int, lane: int = 0) -> np.ndarray:
        """Hashes of the runs of ``size`` words that begin at ``at``."""
        up, down = powers(self.n + 1)
        if lane not in self._sums:
            own = self.words if lane == 0 else mix(self.words * _SECOND)
            self._sums[lane] = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(own * up[: self.n])])
        sums = self._sums[lane]
        return mix((sums[at + size] - sums[at]) * down[at] + np.asarray(size).astype(np.uint64))

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed, first window, number of windows) of each block."""
        if not self.windows:
            none = np.zeros(0, dtype=np.int64)
            return _ZERO, none, none
        grams = self.runs(np.arange(self.n - SEED + 1), SEED)
        least = grams[: self.windows].copy()
        for i in range(1, WINDOW - SEED + 1):
            np.minimum(least, grams[i : i + self.windows], out=least)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        size = np.diff(np.append(first, self.windows))
        if (size > MOST).any():
            parts = -(-size // MOST)
            place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(first, parts) + MOST * place
            size = np.minimum(MOST, np.repeat(size, parts) - MOST * place)
        return least[first], first, size


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _chain(parts: list[np.ndarray], dtype: type = np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=dtype), *parts])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.unique(Text(t.as_py()).blocks()[0]) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([_long(_chain(found))], names=["seed"])


_BLOCKS = "seed long, block long, t1 long, t2 long, doc long, at int, n int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seeds, marks, at, size, counts = [], [], [], [], []
        for t in b.column("text"):
            x = Text(t.as_py())
            s, first, n = x.blocks()
            seeds.append(s)
            marks.append(x.runs(first, n + (WINDOW - 1)) if len(first) else _ZERO)
            at.append(first)
            size.append(n)
            counts.append(len(first))
        own = pa.array(np.repeat(np.arange(len(counts)), counts))
        names = [b.column(c).take(own) for c in ("t1", "t2", "doc")]
        yield pa.RecordBatch.from_arrays(
            [_long(_chain(seeds)), _long(_chain(marks)), *names, pa.array(_chain(at, np.int64).astype(np.int32)), pa.array(_chain(size, np.int64).astype(np.int32))],
            names=["seed", "block", "t1", "t2", "doc", "at", "n"],
        )


_WINDOWS = "h1 long, h2 long, doc long, at int, seed long, block long, off int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the blocks ``own`` of each text."""
    for b in batches:
        for text, doc, own in zip(b.column("text"), b.column("doc"), b.column("own"), strict=True):
            x, rows = Text(text.as_py()), own.values
            n = rows.field("n").to_numpy()
            block = np.repeat(np.arange(len(n)), n)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = rows.field("at").to_numpy()[block] + off
            pick = pa.array(block)
            yield pa.RecordBatch.from_arrays(
                [_long(x.runs(at, WINDOW)), _long(x.runs(at, WINDOW, 1)), pa.array([doc.as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32)), rows.field("seed").take(pick), rows.field("block").take(pick), pa.array(off.astype(np.int32))],
                names=["h1", "h2", "doc", "at", "seed", "block", "off"],
            )


def _named(docs: DataFrame) -> DataFrame:
    """doc, t1, t2 (128 bits that name a row by doc_id, or its lack, and text), text."""
    parts = (F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64(*parts).alias("t1"), F.xxhash64(F.lit(7), *parts).alias("t2"), "text")


def _after(doc: str, other: str) -> Column:
    """Whether one doc_id is larger than the other; null ones come first."""
    return F.struct(F.col(doc).alias("d")) > F.struct(F.col(other).alias("d"))


def _boundary_windows(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """seed, block, own: the windows of distinct blocks that are known from a smaller doc_id, as (off, ref_doc, ref_at)."""
    shared = stored(distinct.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").select("seed"), "shared-seeds")
    odd = stored(distinct.join(shared, "seed").select("seed", "block", "n", "first.doc", "first.t1", "first.t2", "first.at"), "boundary-blocks")
    by_text = odd.groupBy("t1", "t2").agg(F.collect_list(F.struct("at", "n", "seed", "block")).alias("own"))
    texts = _named(docs).join(by_text.hint("shuffle_hash"), ["t1", "t2"])
    # Rows that share doc_id and text hold the same windows; an extra one changes no minimum.
    w = stored(texts.select("text", "doc", "own").mapInArrow(_windows, _WINDOWS), "boundary-windows")
    first = stored(w.groupBy("h1", "h2").agg(F.count("*").alias("k"), F.min(F.struct("doc", "at")).alias("ref")).where("k > 1").drop("k"), "first-windows")
    known = w.join(first, ["h1", "h2"]).where(_after("doc", "ref.doc"))
    return known.groupBy("seed", "block").agg(F.collect_set(F.struct("off", F.col("ref.doc").alias("ref_doc"), F.col("ref.at").alias("ref_at"))).alias("own"))


def copied(docs: DataFrame) -> DataFrame:
    """t1, t2, pieces: what each text copies from smaller doc_ids, as sorted (at, n windows, ref_doc, ref_at)."""
    tune(docs.sparkSession)
    rows = _named(docs)
    often = stored(rows.select("text").mapInArrow(_seeds, "seed long").groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").select("seed"), "seeds")
    blocks = stored(rows.mapInArrow(_blocks, _BLOCKS).join(often, "seed"), "blocks")
    distinct = stored(blocks.groupBy("seed", "block").agg(F.min(F.struct("doc", "t1", "t2", "at")).alias("first"), F.max("n").alias("n"), F.count("*").alias("k")), "distinct-blocks")
    odd = stored(_boundary_windows(docs, distinct), "known-windows")
    index = stored(distinct.join(odd, ["seed", "block"], "left").where("k > 1 OR own IS NOT NULL").select("seed", "block", F.col("first.doc").alias("ref_doc"), F.col("first.at").alias("ref_at"), "own"), "index")
    whole = F.array(F.struct("at", "n", "ref_doc", "ref_at"))
    apart = F.transform("own", lambda x: F.struct((F.col("at") + x["off"]).alias("at"), F.lit(1).alias("n"), x["ref_doc"].alias("ref_doc"), x["ref_at"].alias("ref_at")))
    found = blocks.join(index, ["seed", "block"]).select("t1", "t2", F.explode(F.when(_after("doc", "ref_doc"), whole).otherwise(apart)).alias("p"))
    return found.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("p")).alias("pieces"))


def factors(pieces: list[dict]) -> list[list]:
    """[at, n windows, ref_doc, ref_at]: pieces in order, joined while the reference goes on."""
    out: list[list] = []
    for p in pieces:
        at, n, doc, ref = p["at"], p["n"], p["ref_doc"], p["ref_at"]
        if out and out[-1][2] == doc and out[-1][0] + out[-1][1] == at and out[-1][3] + out[-1][1] == ref:
            out[-1][1] += n
        else:
            out.append([at, n, doc, ref])
    return out


def kept_words(words: list[str], found: list[list]) -> list[str]:
    """The words that no factor covers."""
    kept, at = [], 0
    for start, n, *_ in found:
        kept += words[at:start]
        at = max(at, start + n + WINDOW - 1)
    return kept + words[at:]


def _rewritten(of: Callable[[str | None, list[str], list[str]], tuple], fields: list[pa.Field]):
    """A stage that replaces (text, pieces) by what ``of`` makes of the text, its words and the kept ones; other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, pieces in zip(b.column("text"), b.column("pieces"), strict=True):
                said = text.as_py()
                words = WORD.findall(said or "")
                rows.append(of(said, words, kept_words(words, factors(pieces.as_py() or []))))
            made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *made], names=["row", *[f.name for f in fields]])

    return run


def _with_pieces(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (``columns`` of ``docs``), text, pieces: no name of ``docs`` can clash."""
    parts = (F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.xxhash64(*parts).alias("t1"), F.xxhash64(F.lit(7), *parts).alias("t2"), "text")
    return rows.join(copied(docs.select("doc_id", "text")).hint("shuffle_hash"), ["t1", "t2"], "left").select("row", "text", "pieces")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rewritten, plus n_words and n_removed (long), in place of columns of those names."""
    names = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    fields = [pa.field("text", pa.string()), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64())]
    stage = _rewritten(lambda text, words, kept: (text if len(kept) == len(words) else " ".join(kept), len(words), len(words) - len(kept)), fields)
    rows = _with_pieces(docs, names)
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(stage, f"row {kind}, text string, n_words long, n_removed long")
    return out.select(*[F.col(f"row.`{c}`") for c in names], "text", "n_words", "n_removed")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(doc.as_py(), at, n + WINDOW - 1, *ref) for doc, pieces in zip(b.column("doc"), b.column("pieces"), strict=True) for at, n, *ref in factors(pieces.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(5)], names=["doc_id", "at", "n_words", "ref_doc", "ref_at"])


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, at, n_words, ref_doc, ref_at: the factors (word positions, from 0) of every row that copies."""
    rows = _named(docs).drop("text").join(copied(docs), ["t1", "t2"]).select("doc", "pieces")
    return rows.mapInArrow(_listed, "doc_id long, at long, n_words long, ref_doc long, ref_at long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    fields = [pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept_sha256", pa.string())]
    stage = _rewritten(lambda text, words, kept: (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()), fields)
    rows = _with_pieces(docs, ["doc_id"])
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(stage, f"row {kind}, n_words long, n_removed long, kept_sha256 string").select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def sql() -> str:
    """DuckDB's rows of ``report`` over ``documents`` with distinct doc_ids."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 v AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
 f AS (SELECT x, min(doc_id) AS least FROM v GROUP BY x HAVING count(*) > 1),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM v JOIN f USING (x) WHERE least < doc_id),
 l AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
 k AS (SELECT doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY l.j) FILTER (c.j IS NULL) AS kept FROM l LEFT JOIN c USING (doc_id, j) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
