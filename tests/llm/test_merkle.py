"""The manifest against a plain tree of all rows in memory."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from ledgerlight.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc, source, lang, n, text):
    return H(*map(said, (doc, source, lang, n, text)))


def tree(nodes):
    """(root, proof of each node as (siblings before, siblings after) by level)."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for i, own in enumerate(at):
            for j in own:
                paths[j].append((runs[i // 3][: i % 3], runs[i // 3][i % 3 + 1 :]))
        at = [sum(at[i : i + 3], []) for i in range(0, len(at), 3)]
        nodes = [H(*r) for r in runs]
    return nodes[0], paths


def fold(node, path):
    for before, after in path:
        node = H(*before, node, *after)
    return node


def brute(rows):
    by = {}
    for doc, text, lang, source, n in rows:
        other = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        by.setdefault(source, []).append((doc is not None, doc or 0, leaf(doc, source, lang, n, text), leaf(doc, source, lang, n, other), doc))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        subs.append(tree([x[2] for x in by[s]]))
    root, above = tree([r for r, _ in subs]) if subs else (None, [])
    out = []
    for s, (sub, paths), up in zip(names, subs, above, strict=True):
        for (*_, own, other, doc), path in zip(by[s], paths, strict=True):
            whole = path + up
            got = fold(other, whole)
            out.append((doc, own, sub, root, H(*[h for a, b in whole for h in a + b]), got, got == root))
    return out


def generated(r, n):
    sources = [None, "", "a", "A", "é", "z", "\U00010000", "￿", "big", "big", "big", "big", "big"]
    rows = [(i, r.choice(["x\ny", "plain", "", None, "\n", "é\n😀" * 3]), r.choice(["en", None]), r.choice(sources), r.choice([0, 7, None])) for i in range(n)]
    return rows + [(3, "again", "en", "big", 1), (3, "again", "en", "big", 1), (None, "no id\n", "en", "big", 1), (None, None, None, None, None), (2**61, "lone\nrow", "de", "lone", 4)]


@pytest.mark.parametrize(("n", "levels"), [(0, 6), (40, 6), (900, 2), (900, 1)])
def test_report(spark, monkeypatch, n, levels):
    """Small superblocks make several rounds of reduction."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = generated(random.Random(n), n)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS idx", "'t' AS tree", "0 AS n", "'x' AS node").repartition(6)
    assert Counter(map(tuple, merkle.report(df).collect())) == Counter(brute(rows))


@pytest.mark.parametrize("n", [1, 4, 9, 730])
def test_sizes_around_powers(spark, n):
    rows = [(i, f"t{i}\n", "en", "one", i) for i in range(n)]
    assert Counter(map(tuple, merkle.report(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter(brute(rows))


def test_empty_table(spark):
    assert merkle.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text(spark):
    rows = [(1, "long\n" * 400_000, "en", "s", 5), (2, "short", "en", "s", 5)]
    assert Counter(map(tuple, merkle.report(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter(brute(rows))


def test_manifest_finds_changes(spark, tmp_path):
    rows = generated(random.Random(9), 60)
    path = f"file://{tmp_path}/m"
    df = spark.createDataFrame(rows, SCHEMA)
    assert merkle.write_manifest(df, path) == brute(rows)[0][3]
    assert merkle.changed(df.repartition(5), path).count() == 0
    edited = [r if r[0] != 7 else (7, "edited", *r[2:]) for r in rows if r[0] != 8] + [(5000, "new", "en", "a", 1)]
    edited.remove((3, "again", "en", "big", 1))
    got = {r.doc_id: r.kind for r in merkle.changed(spark.createDataFrame(edited, SCHEMA), path).collect()}
    assert got == {7: "changed", 8: "missing", 5000: "added", 3: "missing"}
    assert merkle.write_manifest(df.limit(0), path + "0") is None
