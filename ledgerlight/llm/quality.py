"""Quality rules: a linear-chain CRF labels lines as content or boilerplate.

Each line with a word has binary features; the chain has one emission weight per
feature and one coupling for equal neighbours. Viterbi decoding marks the best label
sequence of the whole document, and the share of words in content lines decides:
below ``CONTENT_SHARE`` the document goes, as it does when the base rules fail.

The weights are trained by pseudo-likelihood (each label given its neighbours) on at
most ``FIT_ROWS`` labelled documents, the lowest by a hash of their id: lines of
good documents are content; lines of bad documents are boilerplate where a seed rule
fires. The fit needs only how often each (features, label, labels beside) occurs, which Spark
counts; no text reaches the driver. Without labelled rows the prior weights stand.

Edge cases: a null text has no words; empty texts fail the base rules; repeated rows
each get a row; labels with nulls are ignored; extra columns are ignored. Every text
is processed whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import tune

FIT_ROWS = 2000
CONTENT_SHARE = 0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
FEATURES = ("bias", "sentence_end", "short", "symbols", "cells", "shouting", "monotone", "repeated_line", "notice", "digits", "trailing_marks")
#: Prior weights towards content, in the order of FEATURES; training starts here.
PRIOR = np.array([1.0, 1.5, -0.3, -3.0, -3.0, -3.0, -3.0, -1.5, -2.0, -1.0, -1.5])
COUPLING = 0.5
SEEDS = (3, 4, 5, 6, 7, 8)
NOTICE = re.compile(r"cookie|copyright|all rights reserved|licen[cs]e|subscribe|newsletter|privacy|terms of|sign in|log in|click here|share this|©", re.I)
SPACE = b" \t\n\x0b\x0c\r"


def line_features(line: str, seen: bool) -> list[int]:
    """Indexes of the features that hold; ``line`` has a word."""
    words = line.split()
    n, size = len(words), len(line)
    symbols = sum(map(line.count, SYMBOLS))
    letters = sum(map(str.isalpha, line))
    upper = sum(map(str.isupper, line))
    out = [0]
    if line.rstrip()[-1:] in ".!?:\"'»”…":
        out.append(1)
    if n < 4:
        out.append(2)
    if symbols > 0.05 * size:
        out.append(3)
    if line.count("|") > 0.15 * n:
        out.append(4)
    if letters > 20 and upper > 0.5 * letters:
        out.append(5)
    if n >= 8 and len(set(words)) < 0.4 * n:
        out.append(6)
    if seen:
        out.append(7)
    if NOTICE.search(line):
        out.append(8)
    if sum(map(str.isdigit, line)) > 0.2 * size:
        out.append(9)
    if line.count("!!") > 0.3 * n:
        out.append(10)
    return out


def document_lines(text: str) -> tuple[list[list[int]], list[int], int]:
    """Features and word counts of the lines with a word, and how many equal an earlier one."""
    feats, words, seen, dup = [], [], set(), 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            again = line in seen
            dup += again
            seen.add(line)
            feats.append(line_features(line, again) if line.split() else [0, 2])
            words.append(n)
    return feats, words, dup


def viterbi(scores: list[float], coupling: float) -> list[bool]:
    """Best labels (True: content); ``scores`` favour content, equal neighbours gain ``coupling``."""
    back, c, b = [], 0.0, 0.0
    for k, s in enumerate(scores):
        if k == 0:
            c, b = s, 0.0
            continue
        cc, bc = c + coupling, b
        bb, cb = b + coupling, c
        back.append((cc >= bc, cb > bb))
        c, b = max(cc, bc) + s, max(bb, cb)
    label = c >= b
    out = [label]
    for content_from, boiler_from in reversed(back):
        label = content_from if label else boiler_from
        out.append(label)
    return out[::-1]


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows found twice or more, the first included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) == len(words):
        return 0
    v = len(ids)
    code = (a[:-2] * v + a[1:-1]) * v + a[2:] if v < 2_000_000 else np.unique(np.stack([a[:-2], a[1:-1], a[2:]]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(code), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : k + len(code)] |= twice
    return int(inside.sum())


def judge(text: str, weights: np.ndarray, coupling: float) -> tuple:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(raw.count, (bytes([c]) for c in SPACE)))
    symbols = sum(map(raw.count, (c.encode() for c in SYMBOLS)))
    feats, line_words, dup = document_lines(text)
    rep = repeated_words(words)
    failed = n < MIN_WORDS or 100 * rep > 50 * n
    w = weights.tolist()
    labels = viterbi([sum([w[i] for i in f]) for f in feats], coupling) if feats else []
    content = sum(k for k, y in zip(line_words, labels, strict=True) if y)
    return n, word_chars, symbols, dup, rep, failed, not failed and content >= CONTENT_SHARE * n, content


def line_counts(text: str, good: int) -> Counter[tuple[int, int, int]]:
    """How many lines have (features as bits, label, sum of the labels beside as -1 or 1)."""
    feats, _, _ = document_lines(text)
    labels = [1 if good or not set(f) & set(SEEDS) else 0 for f in feats]
    signs = [0, *(2 * y - 1 for y in labels), 0]
    return Counter((sum(1 << i for i in f), y, signs[k] + signs[k + 2]) for k, (f, y) in enumerate(zip(feats, labels, strict=True)))


def train(counts: list[tuple[int, int, int, int]], rounds: int = 300, rate: float = 0.5, hold: float = 0.01) -> tuple[np.ndarray, float]:
    """Pseudo-likelihood fit of emission weights and coupling, held towards the prior; ``counts``: ``line_counts`` with their sums."""
    if len({y for _, y, _, _ in counts}) < 2:
        return PRIOR, COUPLING
    bits, y, beside, n = np.array(counts, dtype=np.int64).T
    x = np.column_stack([bits >> i & 1 for i in range(len(FEATURES))] + [beside]).astype(float)
    # Both labels weigh the same in the fit, whatever the sample's mix.
    weight = n * np.where(y == 1, 0.5 / n[y == 1].sum(), 0.5 / n[y == 0].sum())
    start = np.append(PRIOR, COUPLING)
    p = start.copy()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        p += rate * (x.T @ (weight * (y - q)) - hold * (p - start))
    return p[:-1], float(np.clip(p[-1], 0, 2))


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[tuple[int, int, int, int]]:
    """``line_counts`` and their sums over at most ``rows`` labelled documents, half of each kind.

    Of rows that share a doc_id the one with the least text hash counts. At most some
    thousand combinations of features, label and neighbours can occur.
    """
    picked = None
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").dropDuplicates(["doc_id"])
    for good in (0, 1):
        part = known.where(F.col("quality") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")  # ``rows`` ids at most
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", F.col("quality").cast("int").alias("quality"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[int, int, int]] = Counter()
        for b in batches:
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.update(line_counts(text, good))
        cols = list(zip(*((*k, n) for k, n in total.items()), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["bits", "label", "beside", "n"])

    lines = texts.mapInArrow(count, "bits long, label long, beside long, n long")
    return sorted(map(tuple, lines.groupBy("bits", "label", "beside").agg(F.sum("n").alias("n")).collect()))


def quality(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words."""
    tune(docs.sparkSession)
    weights, coupling = train(sample(docs, labels)) if labels is not None else (PRIOR, COUPLING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t or "", weights, coupling) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"]
