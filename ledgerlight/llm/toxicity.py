"""Toxicity by weak supervision.

Voters (lexicons, a pattern, and dense word beginnings) vote toxic, clean or
abstain. A generative label model with one vote distribution per voter and class is
fitted by EM; voters whose votes stay correlated given the class share one voice. The
model's posteriors label the sample, and a linear classifier on words, word
beginnings, dense word beginnings and lexicon hits is trained on them, held towards zero.
Only the classifier scores documents; two numbers, a slope and an offset fitted to the
sample's labels in their true proportion, turn its margin into a probability.

The sample is at most ``FIT_ROWS`` labelled rows (half of each kind) whose
crc32(doc_id) mod 5 is not 0, the lowest by a hash of their id. Labels serve only to
sample, to pick the word beginnings that vote (no public lexicon knows the insults of an
invented language) and to calibrate; lang, source, doc_id and labels never enter a score.

Edge cases: null and empty texts get the classifier's score of no words; repeated rows
each get a row; a null doc_id is not held out; without labels nothing is learnt and every
text gets the prior ``PRIOR``; extra columns are ignored; an empty table gives no rows.
Very long texts are read whole, one at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import tune

FIT_ROWS = 6000
PREFIX = 4
FOLDS = 5
VOCABULARY = 4000
#: Share of a text's words from which a word beginning is dense, and its least count.
DENSE, DENSE_LEAST = 0.01, 2
#: Share of toxic texts before anything is seen.
PRIOR = 0.05
#: Share of a voter's toxic votes held to be right before anything is seen.
TRUST = 0.9
#: Common insults by strength and language.
STRONG = frozenset("idiot idiots moron morons scum loser losers imbecile vermin filth bastard bastards retard subhuman".split())
MILD = frozenset("stupid trash clown clowns worthless pathetic disgusting dumb fool jerk pig garbage ugly".split())
FOREIGN = frozenset("trottel dummkopf abschaum versager widerlich arschloch crétin connard ordure minable salaud idiota imbécil estúpido basura escoria payaso patético".split())
KNOWN = STRONG | MILD | FOREIGN
WORD = re.compile(r"[^\W\d_]+")
DIRECT = re.compile(r"\b(?:you|he|she|they|are|is|a|an)\W+(?:\w+\W+){0,2}?(?:%s)\b" % "|".join(sorted(STRONG | MILD)))


def features(low: str) -> set[str]:
    """Of a lower-cased text: its words, beginnings of longer words (dash), dense beginnings (equals sign), lexicon hits (number sign)."""
    words = WORD.findall(low)
    out = set(words)
    known = out & KNOWN
    stems = Counter([w[:PREFIX] for w in words if len(w) > PREFIX])
    least = max(DENSE_LEAST, DENSE * len(words))
    out.update([s + "-" for s in stems])
    out.update([s + "=" for s, c in stems.items() if c >= least])
    if known:
        out.add("#known")
        out.update(name for name, lexicon in (("#strong", STRONG), ("#mild", MILD), ("#foreign", FOREIGN)) if known & lexicon)
    if len(known) > 1:
        out.add("#several")
    return out


class Sample:
    """Texts as arrays of feature numbers; the texts themselves are not kept."""

    def __init__(self, texts: Iterable[str]) -> None:
        number: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.direct: list[bool] = []
        for t in texts:
            low = t.lower()
            have = features(low)
            self.direct.append("#known" in have and DIRECT.search(low) is not None)
            own = [number.setdefault(f, len(number)) for f in have]
            self.rows.append(np.sort(np.array(own, dtype=np.int32)))
        self.names = list(number)
        self.number = number

    def __len__(self) -> int:
        return len(self.rows)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of every feature of every text."""
        if not self.rows:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        return np.repeat(np.arange(len(self.rows), dtype=np.int32), [len(r) for r in self.rows]), np.concatenate(self.rows)

    def has(self, feature: str) -> np.ndarray:
        """Which texts have ``feature``."""
        k = self.number.get(feature, -1)
        return np.array([k in r for r in self.rows], dtype=bool)


def stems(sample: Sample, y: np.ndarray, most: int = 16) -> list[str]:
    """Dense word beginnings of labelled toxic rows that clean rows hardly have, strongest first."""
    row, col = sample.flat()
    toxic, m = y[row] == 1, len(sample.names)
    pos, neg = np.bincount(col[toxic], minlength=m), np.bincount(col[~toxic], minlength=m)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    least = max(3, n1 // 200)
    odds = np.log((pos + 0.5) / n1) - np.log((neg + 0.5) / n0)
    strength = odds * np.log1p(pos)
    found = [(-strength[i], f) for i, f in enumerate(sample.names) if f[-1] == "=" and pos[i] >= least and odds[i] > 2.5]
    return [f for _, f in sorted(found)[:most]]


def votes(sample: Sample, learned: list[str]) -> np.ndarray:
    """rows x voters: 1 toxic, 0 clean, -1 abstains."""
    known = sample.has("#known")
    toxic = [sample.has(f) for f in ("#strong", "#mild", "#foreign", "#several")] + [np.array(sample.direct, dtype=bool)] + [sample.has(f) for f in learned]
    out = np.full((len(sample), len(toxic) + 1), -1, dtype=np.int8)
    for k, hit in enumerate(toxic):
        out[hit, k] = 1
    out[~np.any([known, *toxic], axis=0), -1] = 0
    return out


def label_model(v: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, vote distributions [class, voter, vote], voice per voter) by EM.

    A voter's accuracy is how its rate of each vote differs between the classes; a voter that
    abstains says nothing, as most lexicons are of one language.
    """
    n, m = v.shape
    onehot = np.stack([v == k for k in (-1, 0, 1)], axis=2).astype(float)
    spoken = onehot.copy()
    spoken[:, :, 0] = 0
    post = np.where((v == 1).any(axis=1), 0.9, PRIOR)
    voice = np.ones(m)
    x = (v == 1).astype(float)
    # Belief before anything is seen, as strong as the data: of a voter's votes, so many are right.
    said = onehot.sum(axis=0) * [0, 1, 1]
    belief = np.stack([said * [0, 1 - PRIOR, 1 - TRUST], said * [0, PRIOR, TRUST]]) + 0.5
    for _ in range(rounds):
        # Residual correlation of toxic votes given the class: correlated voters share one voice.
        mean = np.stack([((1 - post)[:, None] * x).sum(axis=0) / max(1e-9, (1 - post).sum()), (post[:, None] * x).sum(axis=0) / max(1e-9, post.sum())])
        r = x - (1 - post)[:, None] * mean[0] - post[:, None] * mean[1]
        c = r.T @ r / n
        d = np.sqrt(np.clip(np.diag(c), 1e-9, None))
        corr = np.abs(c / d[:, None] / d[None, :])
        voice = 1 / np.maximum(1, np.where(corr > 0.3, corr, 0).sum(axis=1))
        dist = np.stack([((1 - post)[:, None, None] * onehot).sum(axis=0), (post[:, None, None] * onehot).sum(axis=0)]) + belief
        dist /= dist.sum(axis=2, keepdims=True)
        prior = np.clip(post.mean(), 0.01, 0.99)
        ll = (np.einsum("nmk,cmk->cnm", spoken, np.log(dist)) * voice).sum(axis=2)
        post = logistic(ll[1] - ll[0] - math.log((1 - prior) / prior))
    return post, dist, voice


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def classifier(sample: Sample, post: np.ndarray) -> tuple[float, dict[str, float], np.ndarray]:
    """(bias, weights, margins of the sample) of the linear classifier trained on ``post``."""
    row, col = sample.flat()
    n, m = len(post), len(sample.names)
    count, mass = np.bincount(col, minlength=m), np.bincount(col, post[row], minlength=m)
    base = post.sum()
    gain = np.abs(np.log((mass + 0.5) / (base + 1)) - np.log((count - mass + 0.5) / (n - base + 1))) * np.sqrt(np.minimum(count, 400))
    keep = sorted(f for _, f in sorted((-gain[i], sample.names[i]) for i in np.flatnonzero(count >= 4))[:VOCABULARY])
    at = {f: i for i, f in enumerate(keep)}
    place = np.array([at.get(f, -1) for f in sample.names], dtype=np.int32)[col]
    rows, cols = row[place >= 0], place[place >= 0]
    w, b = np.zeros(len(keep)), math.log((base + PRIOR) / (n - base + 1 - PRIOR))
    weight = np.where(post > 0.5, 0.5 / max(1.0, (post > 0.5).sum()), 0.5 / max(1.0, (post <= 0.5).sum()))
    gw, gb = np.full(len(w), 1e-8), 1e-8
    for _ in range(400):  # AdaGrad on the weighted logistic loss
        g = weight * (logistic(b + np.bincount(rows, w[cols], minlength=n)) - post)
        dw = np.bincount(cols, g[rows], minlength=len(w)) + 1e-3 * w
        db = g.sum()
        gw += dw * dw
        gb += db * db
        w -= 0.15 * dw / np.sqrt(gw)
        b -= 0.15 * db / math.sqrt(gb)
    w[np.abs(w) <= 0.02] = 0
    margin = b + np.bincount(rows, w[cols], minlength=n)
    return float(b), {f: float(x) for f, x in zip(keep, w.tolist(), strict=True) if x}, margin


def calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the probability as a logistic of the margin, by Newton steps held towards (1, 0)."""
    x, p = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(50):
        q = logistic(x @ p)
        grad = x.T @ (weight * (y - q)) - 1e-3 * (p - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        p = p + step * min(1.0, 2.0 / (1e-9 + np.abs(step).max()))
    return float(max(p[0], 0.05)), float(p[1])


def fit(sample: Sample, y: list[int], kinds: dict[int, int]) -> tuple[float, dict[str, float]]:
    """(bias, weights), calibrated; ``kinds`` counts the labelled rows of each kind that were sampled from."""
    labels = np.array(y, dtype=int)
    if len(labels) == 0:
        return math.log(PRIOR / (1 - PRIOR)), {}
    post, _, _ = label_model(votes(sample, stems(sample, labels)))
    bias, weights, margin = classifier(sample, post)
    share = np.array([kinds.get(k, 0) / max(1, (labels == k).sum()) for k in (0, 1)])
    slope, offset = calibrated(margin, labels, share[labels] / max(1e-9, share[labels].mean()))
    return slope * bias + offset, {f: slope * w for f, w in weights.items()}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[Sample, list[int], dict[int, int]]:
    """The sample, its labels and how many rows of each kind it stands for; the driver sees one text at a time."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    kinds = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = None
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    got = docs.where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").select("text", "toxic")  # ``rows`` ids at most
    y: list[int] = []

    def texts() -> Iterator[str]:
        for r in got.orderBy(F.xxhash64("text")).limit(rows).toLocalIterator():
            y.append(r.toxic)
            yield r.text

    return Sample(texts()), y, kinds


def margin_of(bias: float, weights: dict[str, float], text: str | None) -> float:
    if not text:
        return bias
    return bias + sum(map(weights.__getitem__, weights.keys() & features(text.lower())))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    tune(docs.sparkSession)
    bias, weights = fit(*sampled(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [margin_of(bias, weights, t.as_py()) for t in b.column(1)]
            out = [1 / (1 + math.exp(-min(30.0, max(-30.0, x)))) for x in z]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns pass through as they are."""
    tune(docs.sparkSession)
    bias, weights = fit(*sampled(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [margin_of(bias, weights, t.as_py()) for t in b.column("text")]
            yield b.filter(pa.array([x < 0 for x in z], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
