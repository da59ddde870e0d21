"""Substring dedup against a table of all windows in memory."""

import hashlib
import random
import re
from collections import Counter

from ledgerlight.llm import substrings

SCHEMA = "doc_id long, text string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows):
    """(doc_id, n_words, n_removed, kept_sha256) of each row; a missing doc_id is the least."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            x = tuple(w[i : i + 13])
            first[x] = min(first.get(x, key(d)), key(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(d) for j in range(i, i + 13)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept) if gone else t))
    return out


def generated(r, n, vocabulary=400):
    said = [f"w{i}" for i in range(vocabulary)]
    some = lambda k: [r.choice(said) for _ in range(k)]
    passages = [some(r.randrange(8, 60)) for _ in range(25)]
    rows = []
    for d in range(n):
        w = some(r.randrange(0, 40))
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            w += p[a : r.randrange(a, len(p)) + 1] + some(r.randrange(0, 9))
            if r.random() < 0.2:
                w += p
        for _ in range(r.randrange(2)):
            if w:
                w[r.randrange(len(w))] = r.choice(said)
        rows.append((d, r.choice([" ", "\n", " \t", "\x0b\x0c\r"]).join(w)))
    return rows


def test_report_equals_all_windows(spark):
    r = random.Random(4)
    rows = generated(r, 300)
    rows += [(1000 + k, rows[k][1]) for k in range(40)] + [(2000 + k, rows[7][1]) for k in range(60)]  # copies
    rows += [(3000, " ".join(["a"] * 200)), (3001, " ".join(["a"] * 150)), (3002, "x " + " ".join(["a", "b"] * 90)), (3003, " ".join(["a", "b"] * 90) + " x"), (3004, " ".join(["a", "b"] * 7))]
    rows += [(4000, None), (4001, ""), (4002, " \n "), (4003, "one two"), (None, rows[3][1]), (None, rows[3][1]), (None, rows[5][1]), (5, rows[9][1]), (5, rows[9][1]), (-(2**63), rows[9][1])]
    rows += [(5000, "A" + rows[11][1]), (5001, rows[11][1].upper())]
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert Counter(map(tuple, substrings.report(df).collect())) == Counter(w[:4] for w in want)
    clash = df.selectExpr("*", "1 AS n_words", "'r' AS row", "2 AS t1", "named_struct('x', 3) AS pieces")
    left = substrings.dedup(clash)
    assert left.columns == ["doc_id", "row", "t1", "pieces", "text", "n_words", "n_removed"]
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.text, x.row) for x in left.collect()) == Counter((d, n, g, t, "r") for d, n, g, _, t in want)


def test_few_words_and_many_repeats(spark):
    """A vocabulary of two: every seed is hot and stands in many distinct blocks."""
    rows = [r for r in generated(random.Random(8), 80, vocabulary=2)]
    assert Counter(map(tuple, substrings.report(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter(w[:4] for w in brute(rows))


def test_factors_name_what_they_copy(spark):
    rows = generated(random.Random(6), 120) + [(500, None)]
    text = {d: words(t) for d, t in rows}
    found = substrings.parsed(spark.createDataFrame(rows, SCHEMA)).collect()
    covered = Counter()
    for f in found:
        assert f.n_words >= 13 and f.ref_doc < f.doc_id
        assert text[f.doc_id][f.at : f.at + f.n_words] == text[f.ref_doc][f.ref_at : f.ref_at + f.n_words]
    for d in text:
        covered[d] = len({j for f in found if f.doc_id == d for j in range(f.at, f.at + f.n_words)})
    assert all(covered[d] == gone for d, _, gone, *_ in brute(rows))


def test_long_copies_are_one_factor(spark):
    r = random.Random(7)
    w = [f"v{i}" for i in range(500)]
    body = [r.choice(w) for _ in range(3000)]
    rows = [(1, " ".join(body)), (2, " ".join(body)), (3, " ".join(["x"] * 5 + body[100:2900] + ["y"] * 5))]
    found = {(f.doc_id, f.at, f.n_words, f.ref_doc, f.ref_at) for f in substrings.parsed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (2, 0, 3000, 1, 0) in found and max(n for d, _, n, *_ in found if d == 3) > 2700


def test_very_long_texts_in_pieces(spark, monkeypatch):
    r = random.Random(2)
    w = [f"é{i}" for i in range(3000)]
    body = " ".join(r.choice(w) for _ in range(400_000))
    rows = [(1, body), (2, "start here " + body[1000:]), (3, "z" * 3_000_000)]
    assert Counter(map(tuple, substrings.report(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter(x[:4] for x in brute(rows))
    few = words(rows[1][1])[:400]
    whole = substrings.word_hashes(" ".join(few).encode())
    monkeypatch.setattr(substrings, "PIECE", 7)
    assert len(whole) == 400 and (substrings.word_hashes(" ".join(few).encode()) == whole).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substrings.report(df).count() == 0 and substrings.dedup(df).count() == 0 and substrings.parsed(df).count() == 0
