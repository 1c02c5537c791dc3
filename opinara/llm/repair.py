"""Conversation structure repair: the cheapest edits that make turns alternate, decided by integer minima.

A conversation's rows are walked as a DAG; its nodes are (rows read, letters written, state), where the state is the
role written last.  An edge's weight is one big integer: its cost in the high digits, and its letter at the
place of the walk in low digits of fixed width, ended by zeros.  The least sum is the least cost and, of equal costs,
the edits whose letters come first in ASCII order.  Rows are dealt in chunks; a chunk gives the least
weight from each state to each other, and chunks are joined by minima over the state between
them, so a conversation of any length is decided in many tasks.

``Insert`` is never part of a cheapest repair if it costs more than two deletions: the inserted row stands in a pair of
user and assistant; without it and with its partner deleted (at most one deletion) the rest is still in order, or
only a system row is left, which a second deletion removes.  So with the given costs no insertion has to be
tried; ``inserts`` is the most that a walk may make, for other costs and for tests.

Defined for: null ids (one conversation), null turns (first), null roles and texts (one blank), empty and long texts, equal
turns (by a digest of role and text), repeated rows (duplicates), roles other than those three (kept never), no
rows.  Columns beyond the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .order import numbered

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a chunk, and chunks that are joined at once.
CHUNK, FAN = 128, 16
#: States: nothing written, or the last role was system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = 4, (START, ASSISTANT)
#: Digits of the edits; at one place of two walks that agree so far only one role can follow, so the order is that of D, I, K, R.
DELETE, INSERT_U, INSERT_A, KEEP, REROLE_U, REROLE_A = range(1, 7)
PLAN = " DuaKUA"
BITS = 3
ROLES = {"U": "user", "u": "user", "A": "assistant", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that crc32 of ``conv_id:turn`` decides: dropped, emptied, cut, repeated or another role."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"]).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said["role"].alias("role"),
                                said["text"].alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


# --- weights ----------------------------------------------------------------------------------


def chunk_weights(codes: str, costs: Costs, inserts: int) -> list[int | None]:
    """Least weights of a chunk from each state to each other by number of insertions, flat; None: no way.

    ``codes`` has a letter per row: the role's initial (``o``: other), in capitals if truncated, ``-`` if it must go.
    """
    n = len(codes)
    high = BITS * (n + inserts)
    out: list[int | None] = []
    for start in range(STATES):
        now: dict[tuple[int, int], int] = {(start, 0): 0}

        def offer(to: dict[tuple[int, int], int], state: int, j: int, weight: int) -> None:
            if (state, j) not in to or weight < to[state, j]:
                to[state, j] = weight

        def with_inserts(i: int) -> None:
            for j in range(inserts):
                for state in range(STATES):
                    if (state, j) in now:
                        at = BITS * (n + inserts - 1 - i - j)
                        digit, then = (INSERT_A, ASSISTANT) if state == USER else (INSERT_U, USER)
                        offer(now, then, j + 1, now[state, j] + (costs.insert << high) + (digit << at))
        for i, code in enumerate(codes):
            with_inserts(i)
            then: dict[tuple[int, int], int] = {}
            extra = costs.truncated if code.isupper() else 0
            role = code.lower()
            for (state, j), weight in now.items():
                at = BITS * (n + inserts - 1 - i - j)
                offer(then, state, j, weight + (costs.delete << high) + (DELETE << at))
                if role == "-":
                    continue
                if role == "s" and state == START:
                    offer(then, SYSTEM, j, weight + (extra << high) + (KEEP << at))
                wanted, digit, follows = ("a", REROLE_A, ASSISTANT) if state == USER else ("u", REROLE_U, USER)
                if role == wanted:
                    offer(then, follows, j, weight + (extra << high) + (KEEP << at))
                else:
                    offer(then, follows, j, weight + (extra + costs.rerole << high) + (digit << at))
            now = then
        with_inserts(n)
        out += [now.get((state, j)) for state in range(STATES) for j in range(inserts + 1)]
    return out


def joined_weights(a: list[int | None], n_a: int, b: list[int | None], n_b: int, inserts: int) -> list[int | None]:
    """Least weights of two neighbouring chunks of ``n_a`` and ``n_b`` rows as one."""
    per = inserts + 1
    mask_a, mask_b = (1 << BITS * (n_a + inserts)) - 1, (1 << BITS * (n_b + inserts)) - 1
    high = BITS * (n_a + n_b + inserts)
    out: list[int | None] = [None] * len(a)
    for start in range(STATES):
        for between in range(STATES):
            for j in range(per):
                first = a[(start * STATES + between) * per + j]
                if first is None:
                    continue
                for end in range(STATES):
                    for k in range(per - j):
                        second = b[(between * STATES + end) * per + k]
                        if second is None:
                            continue
                        cost = (first >> BITS * (n_a + inserts)) + (second >> BITS * (n_b + inserts))
                        letters = ((first & mask_a) >> BITS * (inserts - j) << BITS * (n_b + k)) | (second & mask_b) >> BITS * (inserts - k)
                        weight = (cost << high) + (letters << BITS * (inserts - j - k))
                        at = (start * STATES + end) * per + j + k
                        if out[at] is None or weight < out[at]:
                            out[at] = weight
    return out


def decided(weights: list[int | None], n: int, inserts: int) -> tuple[int, str]:
    """Cost and plan of a whole conversation: a letter per edit, capital U and A for a new role, small ones for an insertion."""
    per = inserts + 1
    best = min(w for end in ENDS for j in range(per) if (w := weights[(START * STATES + end) * per + j]) is not None)
    width = n + inserts
    letters = best & ((1 << BITS * width) - 1)
    digits = f"{letters:0{width}o}" if width else ""
    return best >> BITS * width, digits.rstrip("0").translate({ord(str(d)): PLAN[d] for d in range(1, 7)})


def audit(plan: Column) -> Column:
    """Initials of a plan's edits: Delete, Insert, Keep, Rerole."""
    return F.translate(plan, "uaUA", "IIRR")


# --- on Spark -------------------------------------------------------------------------------


def _numbers(weights: list[int | None]) -> list[str | None]:
    return [None if w is None else f"{w:o}" for w in weights]


_PART = "key string, chunk long, n int, first string, last string, illegal long, weights array<string>"


def _is_illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows in order (``pos``), and each one's first ``fault`` (blank, duplicate, truncated or null) without its text."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = conversations.select(
        "conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "turn", "role", "text",
        bare.alias("bare"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("conv_id", "key", "turn", "role", "text", "row", (F.col("bare") == "").alias("blank"),
                       (~F.substring("bare", -1, 1).isin(".", "!", "?")).alias("truncated"),
                       F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"))
    placed = numbered(rows, "key", [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")], "repair-rows")
    firsts = (placed.where("not blank").groupBy("key", "digest").agg(F.min("pos").alias("pos"))
              .select("key", "pos", F.lit(True).alias("first")))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated"))
    faults = placed.select("key", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated").join(firsts, ["key", "pos"], "left")
    return placed, saved(faults.select("key", "pos", "turn", "initial", fault.alias("fault")), "repair-faults")


def solve(faults: DataFrame, costs: Costs, inserts: int) -> DataFrame:
    """``(key, illegal, cost, plan, pieces)`` of each conversation; ``pieces`` are the plan by chunks of rows."""
    initial, fault = F.col("initial"), F.col("fault")
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(role)).otherwise(role)
    spelled = "array_join(transform(members, m -> m.{0}), '')"
    chunks = (faults.select("key", "pos", code.alias("code"), role.alias("role")).groupBy("key", F.expr(f"pos div {CHUNK}").alias("chunk"))
              .agg(F.array_sort(F.collect_list(F.struct("pos", "code", "role"))).alias("members"))
              .select("key", "chunk", F.expr(spelled.format("code")).alias("codes"), F.expr(spelled.format("role")).alias("roles")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str | None]] = {}
        for batch in batches:
            out = []
            for key, chunk, codes, roles in zip(*(c.to_pylist() for c in batch.columns)):
                if codes not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[codes] = _numbers(chunk_weights(codes, costs, inserts))
                out.append((key, chunk, len(codes), roles[0], roles[-1], sum(map(_is_illegal, roles, roles[1:])), known[codes]))
            yield _batch(out)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, chunk, members in zip(*(c.to_pylist() for c in batch.columns)):
                a = members[0]
                n, last, illegal, weights = a["n"], a["last"], a["illegal"], [w and int(w, 8) for w in a["weights"]]
                for b in members[1:]:
                    weights = joined_weights(weights, n, [w and int(w, 8) for w in b["weights"]], b["n"], inserts)
                    illegal += b["illegal"] + _is_illegal(last, b["first"])
                    n, last = n + b["n"], b["last"]
                out.append((key, chunk, n, a["first"], last, illegal, _numbers(weights)))
            yield _batch(out)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, _, n, _, _, illegal, weights in zip(*(c.to_pylist() for c in batch.columns)):
                cost, plan = decided([w and int(w, 8) for w in weights], n, inserts)
                out.append((key, illegal, cost, plan, list(_pieces(plan))))
            names = ("key", "illegal", "cost", "plan", "pieces")
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], list(names))
    parts = saved(chunks.mapInArrow(weigh, _PART), "repair-chunks")
    step = 0
    while not parts.where("chunk > 0").isEmpty():
        step += 1
        members = F.array_sort(F.collect_list(F.struct("chunk", *_PART_FIELDS))).alias("members")
        parts = saved(parts.groupBy("key", F.expr(f"chunk div {FAN}").alias("chunk")).agg(members).mapInArrow(join, _PART), f"repair-chunks-{step}")
    return parts.mapInArrow(decide, "key string, illegal long, cost long, plan string, pieces array<string>")


_PART_FIELDS = ("n", "first", "last", "illegal", "weights")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)],
                                      ["key", "chunk", *_PART_FIELDS])


def _pieces(plan: str) -> Iterator[str]:
    """The plan cut after every ``CHUNK`` rows; an insertion stands before its next row, the last ones at the end."""
    start = rows = 0
    for at, letter in enumerate(plan):
        if letter not in "ua":
            if rows == CHUNK:
                cut = at
                while cut > start and plan[cut - 1] in "ua":
                    cut -= 1
                yield plan[start:cut]
                start, rows = cut, 0
            rows += 1
    yield plan[start:]


def repaired(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """``(key, pos, step, turn, role, text, edit)``: the rows that remain, in order of ``pos`` and ``step``.

    A chunk's piece of the plan meets its rows in one task, whatever the length of the conversation.
    """
    pieces = solved.select("key", F.posexplode("pieces").alias("chunk", "piece"))
    pieces = pieces.select("key", F.col("chunk").cast("long").alias("chunk"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("turn"),
                           F.lit(None).cast("string").alias("role"), F.col("piece").alias("text"))
    rows = placed.select("key", F.expr(f"pos div {CHUNK}").alias("chunk"), "pos", "turn", "role", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, at, chunk = "", 0, 0
        out: list[tuple] = []

        def inserted(key, pos, step) -> int:
            nonlocal at
            while at < len(plan) and plan[at] in "ua":
                out.append((key, pos, step, None, ROLES[plan[at]], "", "insert"))
                at, step = at + 1, step + 1
            return step
        last = None
        for batch in batches:
            for key, chunk, pos, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if pos < 0:
                    if last is not None:
                        inserted(*last, 1_000_000)
                    plan, at, last = text, 0, (key, chunk * CHUNK)
                    continue
                step = inserted(key, pos, 0)
                letter, at, last = plan[at], at + 1, (key, pos)
                if letter != "D":
                    out.append((key, pos, step, turn, ROLES.get(letter, role), text, "keep" if letter == "K" else "rerole"))
            if out:
                yield _rows(out)
                out.clear()
        if last is not None:
            inserted(*last, 1_000_000)
        if out:
            yield _rows(out)
    dealt = rows.unionByName(pieces).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "pos")
    return dealt.mapInArrow(apply, "key string, pos long, step int, turn long, role string, text string, edit string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      ["key", "pos", "step", "turn", "role", "text", "edit"])


def repair(conversations: DataFrame, costs: Costs = Costs(), inserts: int = 0) -> tuple[DataFrame, DataFrame]:
    """The conversations' reports and the rows that remain.

    Reports: ``key``, counts of faults, ``gaps``, ``illegal`` neighbours, ``cost`` and ``plan``; rows: see ``repaired``.
    ``conversations`` are rows as they are; ``damaged`` makes such with faults.
    """
    if inserts == 0 and costs.insert <= 2 * costs.delete:
        raise ValueError("with these costs an insertion can be cheapest: say how many may be made")
    placed, faults = ordered(conversations)
    solved = saved(solve(faults, costs, inserts), "repair-plans")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    reports = faults.groupBy("key").agg(gaps, *counts).join(solved.drop("pieces"), "key")
    return reports, repaired(placed, solved)


def text_digests(rows: DataFrame) -> DataFrame:
    """``(key, digest)``: sha256 of each conversation's ``role:text`` lines, streamed in order.

    A hash over a whole conversation has to see its rows one after the other: they pass one task, row by row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for k, role, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if k != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_pylist([{"key": k, "digest": d} for k, d in done])
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "digest": digest.hexdigest()}])
    order = rows.select("key", "pos", "step", "role", "text").repartition("key").sortWithinPartitions("key", "pos", "step")
    return order.mapInArrow(run, "key string, digest string")
