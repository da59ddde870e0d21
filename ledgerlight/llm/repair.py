"""Conversation structure repair: the cheapest edits that give turns of a legal order.

Role initials must read ``(s?(ua)+)?``. Every row is kept (0), given the role user or
assistant (1) or deleted (2, the only choice for blank and repeated rows); an empty
turn may be inserted anywhere (5); a truncated row that stays costs 5 more. The edits
are a path through a lattice of (rows consumed, grammar state) that is never built:
Dijkstra's search by the key (cost, audit) expands nodes as they are popped and stops at
the first accepting node behind the last row. The audit holds the edits' initials (K, R,
D, I), so that ties go to the ASCII-least one. A cheaper node never has an audit that
begins an equally dear one's at the same node (the rest would be inserts, which
cost), so the least key of a node is final when it is popped.

Conversations of more than ``BLOCK`` rows are searched block by block, from each state a block
can begin in to each it can end in, and the blocks' tables are chained; the result is the same
and the audits in the queue stay short.

Two passes over partitions by conv_id, sorted by turn. The first carries no text:
a row's initial, its fault and 128 bits of its role and text. The second reads a
conversation's edits, then its rows one by one. A conversation is one task, as the digest of its
text is sequential, but no task holds its texts: the first pass holds some 70 bytes a row, the second one text.

Edge cases: a null role or text is one space, so it is blank or has an initial outside the
grammar; null turns come first; rows of one turn follow in the order of role and of the hashes of
their texts; rows with a null conv_id are one conversation; a conversation all of
whose rows are dropped has zeros, an empty audit and the hash of nothing; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, tune

SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SOUND, BLANK, CUT, REPEAT = range(4)
BLOCK = 512
#: Grammar states: nothing yet, after s, after u, after a. The first and the last accept.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTS = (0, 3)
LEGAL = {"su", "ua", "au"}
PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
OUT_BYTES = 4 << 20


def wanted(state: int) -> tuple[int, str]:
    """The state after, and the role of, a turn that an edit adds in ``state``."""
    return (3, "assistant") if state == 2 else (2, "user")


def search(initials: list[str], faults: list[int], start: int = 0, to_all: bool = False) -> dict[int, tuple[int, str]]:
    """State behind the last row: (cost, audit). Only the first accepting one, or all that can be reached from ``start``."""
    n, queue, done, found = len(initials), [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (to_all or state in ACCEPTS):
            found[state] = cost, audit
            if not to_all:
                break
        after, _ = wanted(state)
        if i < n:
            if faults[i] in (SOUND, CUT):
                own = TRUNCATED if faults[i] == CUT else 0
                if (kept := NEXT.get((state, initials[i]))) is not None:
                    heapq.heappush(queue, (cost + own + KEEP, audit + "K", i + 1, kept))
                heapq.heappush(queue, (cost + own + REROLE, audit + "R", i + 1, after))
            heapq.heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
        heapq.heappush(queue, (cost + INSERT, audit + "I", i, after))
    return found


def cheapest(initials: list[str], faults: list[int], block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the repair of one conversation."""
    if len(initials) <= block:
        return next(iter(search(initials, faults).values()))
    best = {0: (0, "")}
    for at in range(0, len(initials), block):
        part, later = (initials[at : at + block], faults[at : at + block]), {}
        for state, (cost, audit) in best.items():
            for end, (more, edits) in search(*part, state, True).items():
                later.setdefault(end, []).append((cost + more, audit + edits))
        best = {end: min(keys) for end, keys in later.items()}
    return min(best[state] for state in ACCEPTS if state in best)


def _plan(rows: list[tuple]) -> tuple:
    """The columns of ``PLAN`` for the rows (initial, fault, mark, turn) of one conversation."""
    initials, faults, seen = [], [], set()
    for initial, fault, mark, _ in rows:
        faults.append(REPEAT if fault != BLANK and mark in seen else fault)
        seen.add(mark)
        initials.append(initial)
    turns = {t for *_, t in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count(BLANK), faults.count(REPEAT), faults.count(CUT), illegal, *cheapest(initials, faults)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, iterator over its rows) of rows that come conversation by conversation."""
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def own():
            nonlocal row
            while row is not None and row[0] == conv:
                yield row[1:]
                row = next(rows, None)

        rest = own()
        yield conv, rest
        for _ in rest:  # what the caller left
            pass


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _arrow(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows``, ended by count or by the characters in them."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= 1000 or size >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


_PLAN_FIELDS = [pa.field(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in PLAN.split(", ")]
_PLANS = pa.schema([pa.field("conv_id", pa.int64()), *_PLAN_FIELDS])


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv, own in _groups(_tuples(batches)):
            yield conv, *_plan([(initial, fault, (h1, h2), turn) for dropped, turn, initial, h1, h2, fault in own if not dropped])

    return _arrow(rows(), _PLANS)


def _edited(own: Iterator[tuple], audit: str) -> Iterator[tuple]:
    """(edit, turn, role, text) of the turns that a repair leaves."""
    state = 0
    for edit in audit:
        after, role = wanted(state)
        if edit == "I":
            state = after
            yield edit, None, role, ""
            continue
        turn, given, text = next(own)
        if edit == "D":
            continue
        state, role = (after, role) if edit == "R" else (NEXT[state, given[:1]], given)
        yield edit, turn, role, text


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, plan, iterator over (turn, role, text)): the plan is a conversation's first row."""
    for conv, own in _groups(_tuples(batches)):
        _, plan, *_ = next(own)
        yield conv, plan, ((turn, role, text) for _, _, dropped, turn, role, _, _, text in own if not dropped)


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _arrow(((conv, k, *x) for conv, plan, own in _led(batches) for k, x in enumerate(_edited(own, plan["audit"]))), _REPAIRED)


_DIGESTS = pa.schema([*_PLANS, pa.field("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv, plan, own in _led(batches):
            sha = hashlib.sha256()
            for k, (_, _, role, text) in enumerate(_edited(own, plan["audit"])):
                sha.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
            yield conv, *plan.values(), sha.hexdigest()

    return _arrow(rows(), _DIGESTS)


def faulty(rows: DataFrame) -> DataFrame:
    """conv_id, dropped, turn, role, h1, h2, text, fault: nulls replaced, each row's own faults found."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    body = F.rtrim(text, F.lit(SPACES))
    fault = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    return rows.select("conv_id", dropped.alias("dropped"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), role, text).alias("h2"), text.alias("text"), fault.alias("fault"))


def plans(rows: DataFrame) -> DataFrame:
    """conv_id and the columns of ``PLAN``, a row per conversation. Rows that are ``dropped``, if there is such a column, only name their conversation."""
    tune(rows.sparkSession)
    narrow = faulty(rows).select("conv_id", "dropped", "turn", "role", "h1", "h2", F.substring("role", 1, 1).alias("initial"), "fault")
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h1", "h2")
    return dealt.select("conv_id", "dropped", "turn", "initial", "h1", "h2", "fault").mapInArrow(_plans, f"conv_id long, {PLAN}")


def _with_plans(rows: DataFrame) -> DataFrame:
    """Rows in order, each conversation's behind its plan."""
    found = stored(plans(rows), "repair-plans")
    lead = found.select("conv_id", F.struct(*[c.split()[0] for c in PLAN.split(", ")]).alias("plan"), F.lit(True).alias("lead"))
    own = faulty(rows).drop("fault").withColumn("lead", F.lit(False))
    both = own.unionByName(lead, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("lead"), "turn", "role", "h1", "h2")
    return dealt.select("conv_id", "lead", "plan", "dropped", "turn", "role", "h1", "h2", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R, I), turn (null: inserted), role, text: the turns after the repair."""
    return _with_plans(rows).mapInArrow(_repaired, "conv_id long, place long, edit string, turn long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, the columns of ``PLAN`` and repaired_sha256 of the repaired ``role:text`` lines."""
    return _with_plans(rows).mapInArrow(_digests, f"conv_id long, {PLAN}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of (conv_id, turn): dropped (flagged), emptied, without marks, repeated, given the role user."""
    given = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(given["conv_id"], F.lit(":"), given["turn"]).cast("binary")) % 20

    def on(k: int, then: Column, other: Column) -> Column:
        return F.when(F.col("kind") == k, then).otherwise(other)

    rows = conversations.select("conv_id", "turn", given["role"].alias("role"), given["text"].alias("text"), kind.alias("kind"))
    text = on(1, F.lit(""), on(2, F.translate("text", ".!?", ""), F.col("text")))
    copies = F.explode(F.sequence(F.lit(1), on(3, F.lit(2), F.lit(1))))
    return rows.select("conv_id", "turn", on(4, F.lit("user"), F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def report(conversations: DataFrame) -> DataFrame:
    return digests(damaged(conversations))
