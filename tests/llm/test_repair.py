"""Conversation repair against exhaustive search and a plain reading of the contract."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

from ledgerlight.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def every_repair(initials, faults, inserts=3):
    """The least (cost, audit) over all edit sequences with at most ``inserts`` inserts: no search order, no states."""
    n, best = len(initials), None
    for own in product("KRD", repeat=n):
        for gaps in product(range(inserts + 1), repeat=n + 1):
            if sum(gaps) > inserts:
                continue
            audit = "".join("I" * g + e for g, e in zip(gaps, [*own, ""], strict=True))
            for said in product("ua", repeat=audit.count("R") + audit.count("I")):
                free, out, cost, i = iter(said), "", 0, 0
                for e in audit:
                    if e == "I":
                        out, cost = out + next(free), cost + 5
                        continue
                    f = faults[i]
                    if e == "D":
                        cost += 2
                    elif f in (repair.BLANK, repair.REPEAT):
                        break
                    else:
                        cost += (e == "R") + 5 * (f == repair.CUT)
                        out += next(free) if e == "R" else initials[i]
                    i += 1
                else:
                    if GRAMMAR.match(out) and (best is None or (cost, audit) < best):
                        best = cost, audit
    return best


def layered(initials, faults):
    """Least (cost, audit) by layers of rows, with the inserts of a layer relaxed until nothing changes."""
    layer = {0: (0, "")}

    def relax(layer):
        for _ in range(4):
            for s, (c, a) in list(layer.items()):
                t = 3 if s == 2 else 2
                layer[t] = min(layer.get(t, (c + 5, a + "I")), (c + 5, a + "I"))
        return layer

    layer = relax(layer)
    for x, f in zip(initials, faults, strict=True):
        new = {}
        for s, (c, a) in layer.items():
            moves = [(s, c + 2, "D")]
            if f in (repair.SOUND, repair.CUT):
                extra = 5 * (f == repair.CUT)
                moves.append((3 if s == 2 else 2, c + 1 + extra, "R"))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, x))
                if to is not None:
                    moves.append((to, c + extra, "K"))
            for t, cost, e in moves:
                new[t] = min(new.get(t, (cost, a + e)), (cost, a + e))
        layer = relax(new)
    return min(layer[s] for s in (0, 3) if s in layer)


def test_search_is_exhaustive():
    r = random.Random(1)
    for _ in range(60):
        n = r.randrange(4)
        initials, faults = [r.choice("suax") for _ in range(n)], [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert repair.cheapest(initials, faults) == every_repair(initials, faults), (initials, faults)


def test_blocks_change_nothing():
    r = random.Random(2)
    for _ in range(150):
        n = r.randrange(1, 60)
        initials, faults = [r.choice("ssuuaaax") for _ in range(n)], [r.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n)]
        want = layered(initials, faults)
        assert repair.cheapest(initials, faults) == want
        assert repair.cheapest(initials, faults, block=7) == want == repair.cheapest(initials, faults, block=1)


def brute(rows):
    """The contract's columns, read plainly; rows of one turn are not ordered further."""
    convs, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if x is None else x for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        own = convs[conv]
        k = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        faults, seen = [], set()
        for _, role, text in own:
            body = text.strip(SPACE)
            faults.append(repair.BLANK if not body else repair.REPEAT if (role, text) in seen else repair.CUT if body[-1] not in ".!?" else repair.SOUND)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in own]
        cost, audit = layered(initials, faults)
        said, i = [], 0
        for e in audit:
            if e == "I":
                said.append(("user" if len(said) == 0 or said[-1][0][:1] in "sa" else "assistant", ""))
                continue
            _, role, text = own[i]
            i += 1
            if e == "K":
                said.append((role, text))
            elif e == "R":
                said.append(("user" if len(said) == 0 or said[-1][0][:1] in "sa" else "assistant", text))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in (repair.BLANK, repair.REPEAT, repair.CUT)), illegal, cost, audit, sha, tuple(said))
    return out


def generated(r):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Ends so.  \n", "Repeated.", None, "one. two"]
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = r.choice(["system", "tool", None, "", "umpire"]) if r.random() < 0.15 else role
            rows.append((conv, turn * r.choice([1, 1, 1, 3]) + turn * 10, role, r.choice(texts)))
    rows += [(77, None, "user", "A question?"), (77, 5, "assistant", "An answer."), (None, 0, "user", "Who?"), (None, 1, "assistant", "Nobody."), (-3, None, None, None), (2**60, 2**61, "user", "x." * 100_000)]
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(1300)]
    return rows + [(1000 + k, 0, "user", "Alone?") for k in range(60)]  # some lose their only row


def test_report_and_repaired_rows(spark):
    rows = generated(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS kind", "1 AS copy", "2 AS plan", "3 AS lead").repartition(5)
    want = brute(rows)
    got = {x.conv_id: x for x in repair.report(df).collect()}
    assert set(got) == set(want) and any(not w[-1] and w[5] == 0 for w in want.values())
    for conv, x in got.items():
        assert tuple(x)[1:] == want[conv][:8], conv
    turns = defaultdict(list)
    for x in sorted(repair.repaired(repair.damaged(df)).collect(), key=lambda x: x.place):
        turns[x.conv_id].append((x.role, x.text))
    assert {c: tuple(t) for c, t in turns.items()} == {c: w[-1] for c, w in want.items() if w[-1]}


def test_rows_of_one_turn_and_empty_tables(spark):
    rows = [(1, 0, "user", "Same?"), (1, 0, "user", "Same?"), (1, 0, "assistant", "Other."), (2, 0, "assistant", "b."), (2, 0, "assistant", "a.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.conv_id: x for x in repair.digests(df).collect()}
    assert got[1].duplicate == 1 and got[1].gaps == 0 and got[1].cost == 4  # role order puts the assistant first: two new roles and a deletion
    assert sorted(map(tuple, repair.digests(df.repartition(3)).collect())) == sorted(map(tuple, got.values()))
    assert repair.report(df.limit(0)).count() == 0 and repair.repaired(df.limit(0)).count() == 0


def test_given_conversations(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    got = {x.conv_id: tuple(x)[1:] for x in repair.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {c: w[:8] for c, w in want.items()}
