from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from opinara.llm import repair
from opinara.llm.queries import op13
from opinara.llm.repair import Costs, chunk_weights, decided, joined_weights

SPACES = " \t\n\x0b\x0c\r"
LETTERS = str.maketrans("uaUA", "IIRR")


def best(codes, costs=Costs(), inserts=0):
    """All edits of all rows with up to ``inserts`` insertions anywhere."""
    found = []
    for kept in itertools.product("DKUA", repeat=len(codes)):
        for n in range(inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(codes) + 1), n):
                for roles in itertools.product("ua", repeat=n):
                    plan, out, cost = "", "", 0
                    for i in range(len(codes) + 1):
                        for p, r in zip(places, roles):
                            if p == i:
                                plan, out, cost = plan + r, out + r, cost + costs.insert
                        if i == len(codes):
                            break
                        letter, code = kept[i], codes[i]
                        plan += letter
                        if letter == "D":
                            cost += costs.delete
                        else:
                            out += code.lower() if letter == "K" else letter.lower()
                            cost += (letter != "K") * costs.rerole + code.isupper() * costs.truncated + (code == "-") * 10**6
                    if re.fullmatch("(s?(ua)+)?", out):
                        found.append((cost, plan.translate(LETTERS)))
    return min(found)


def solved(codes, costs=Costs(), inserts=0, chunk=100):
    parts = [codes[i:i + chunk] for i in range(0, len(codes), chunk)] or [""]
    weights, n = chunk_weights(parts[0], costs, inserts), len(parts[0])
    for p in parts[1:]:
        weights, n = joined_weights(weights, n, chunk_weights(p, costs, inserts), len(p), inserts), n + len(p)
    cost, plan = decided(weights, n, inserts)
    return cost, plan.translate(LETTERS)


def test_every_short_conversation_equals_all_edits():
    for n in range(5):
        for codes in itertools.product("suaoSUA-", repeat=n):
            codes = "".join(codes)
            assert solved(codes) == best(codes), codes


def test_insertions_are_never_cheapest():
    rng = random.Random(1)
    for codes in [*map("".join, itertools.product("suaUA-", repeat=3)), *("".join(rng.choices("suaA-", k=4)) for _ in range(40))]:
        assert solved(codes, inserts=2) == best(codes, inserts=2) == best(codes), codes


def test_cheap_insertions_and_chunks():
    costs = Costs(rerole=3, delete=4, insert=1, truncated=2)
    rng = random.Random(2)
    for _ in range(60):
        codes = "".join(rng.choices("suaoUA-", k=rng.randint(0, 4)))
        assert solved(codes, costs, 2) == best(codes, costs, 2), codes
    for _ in range(100):
        codes = "".join(rng.choices("suaoSUA-", k=rng.randint(1, 60)))
        for c, inserts in ((Costs(), 0), (costs, 3)):
            assert solved(codes, c, inserts, 7) == solved(codes, c, inserts)


def reference(rows):
    """The contract, row by row; the edits by a walk over (row, state) with strings."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = groups[conv]
        said = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2], said[3]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults, codes = set(), [], ""
        for _, role, text in kept:
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "-" if fault in ("blank", "duplicate") else code.upper() if fault else code
        ways = {"": (0, "", "")}  # by last role: cost, letters, their meaning
        for code in codes:
            then = {}
            for last, (cost, letters, plan) in ways.items():
                options = [(last, 2, "D", "D")]
                if code != "-":
                    extra = 5 * code.isupper()
                    if code in "sS" and not last:
                        options.append(("s", extra, "K", "K"))
                    to = "a" if last == "u" else "u"
                    options.append((to, extra, "K", "K") if code.lower() == to else (to, extra + 1, "R", to))
                for state, more, letter, meaning in options:
                    then[state] = min(then.get(state, (10**9,)), (cost + more, letters + letter, plan + meaning))
            ways = then
        cost, letters, plan = min(w for last, w in ways.items() if last in ("", "a"))
        lines = [f"{ {'u': 'user', 'a': 'assistant'}.get(p, role)}:{text}" for p, (_, role, text) in zip(plan, kept) if p != "D"]
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as key", "'y' as pos").write.parquet(
        path + "/conversations.parquet")
    got = op13(spark, path).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def conversation(rng, conv, n):
    says = ["Yes.", "No!", "Why?", "and then", "  ", "", "Fine. \n", "é 漢.", None]
    return [(conv, t if rng.random() > 0.02 else None, rng.choice(["system"] + ["user", "assistant"] * 9 + ["tool", None, ""]),
             rng.choice(says) if rng.random() < 0.5 else f"{rng.random()}.") for t in range(n)]


def test_query_equals_the_contract(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 8)
    monkeypatch.setattr(repair, "FAN", 2)
    rng = random.Random(3)
    rows = [r for c in range(60) for r in conversation(rng, c, rng.randint(1, 12))] + conversation(rng, None, 7)
    rows += conversation(rng, 99, 300) + [(7, 3, "user", "Again.")] * 4 + [(8, 1, "user", "word " * 30_000 + "x" * 70_000)]
    assert found(spark, tmp_path, rows) == reference(rows)


def test_no_rows_and_all_dropped(spark, tmp_path):
    dropped = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert len(dropped) > 3
    assert found(spark, tmp_path, dropped) == reference(dropped)
    assert found(spark, tmp_path / "empty", []) == []


def test_rows_that_remain_with_insertions(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 2)
    costs = Costs(rerole=9, delete=9, insert=1, truncated=9)
    rows = [(1, i, r, f"{i}.") for i, r in enumerate(["user", "user", "assistant", "assistant", "user"])]
    _, left = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), costs, 4)
    left = [(r.role, r.text, r.edit) for r in left.orderBy("pos", "step").collect()]
    assert left == [("user", "0.", "keep"), ("assistant", "", "insert"), ("user", "1.", "keep"), ("assistant", "2.", "keep"),
                    ("user", "", "insert"), ("assistant", "3.", "keep"), ("user", "4.", "keep"), ("assistant", "", "insert")]
    with pytest.raises(ValueError):
        repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), costs)
