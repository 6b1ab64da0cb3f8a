"""Conversation repair against all edits of small conversations, and its edges."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from riftline.llm.repair import Repair, damage, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def all_edits(rows):
    """The cheapest repair by trying every way to keep, rerole or delete and every number of turns inserted."""
    best = None
    choices = [[("D", 2, None)] + ([] if gone else [("K", 5 * cut, role), ("R", 1 + 5 * cut, "user"), ("R", 1 + 5 * cut, "assistant")]) for role, _, gone, cut in rows]
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for picked in itertools.product(*choices):
        cost = sum(c for _, c, _ in picked)
        if best and cost > best[0]:
            continue
        for between in itertools.product(inserts, repeat=len(rows) + 1):
            whole = cost + 5 * sum(map(len, between))
            if best and whole > best[0]:
                continue
            turns, audit = [], ""
            for n in range(len(rows) + 1):
                turns += [(r, "") for r in between[n]]
                audit += "I" * len(between[n])
                if n < len(rows):
                    audit += picked[n][0]
                    if picked[n][2] is not None:
                        turns.append((picked[n][2], rows[n][1]))
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
                new = (whole, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
                best = new if best is None or new < best else best
    return best


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_of_all_edits(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), f"t{k}", rng.random() < 0.25, rng.random() < 0.3) for k in range(rng.randint(0, 4))]
    made = Repair()
    for row in rows:
        made.add(*row)
    assert made.finish() == all_edits(rows)


def by_hand(rows):
    """The contract's columns for one conversation of (turn, role, text) rows after damage, in order."""
    seen, faults, edits = set(), [], []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        edits.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, sha = all_edits(edits)
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": pairs, "cost": cost, "audit": audit, "repaired_sha256": sha}


def damaged(conv_id, rows):
    out = []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_whole_conversations(spark):
    rng = random.Random(5)
    made = {}
    for conv in [None, 2**53 + 1, *range(60)]:
        made[conv] = [(rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["system", "user", "assistant", None]), rng.choice(["yes.", "no!  ", "well", "", None, " \t", "yes."])) for _ in range(rng.randint(1, 4))]
    made[1000] = [(t, "user", "x.") for t in range(40) if zlib.crc32(f"1000:{t}".encode()) % 20 == 0]  # nothing left
    rows = [(c, *r) for c, rs in made.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS seen", "2 AS times", "3 AS audit", "4 AS there")
    got = {r["conv_id"]: r.asDict() for r in repair_conversations(df).collect()}
    assert got.keys() == made.keys()
    for conv, rs in made.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == by_hand(damaged(conv, rs)), conv
    assert got[1000]["audit"] == "" and got[1000]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(none).count() == 0 and damage(none).count() == 0
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "x" * 200_000 + ".") for t in range(30)]
    got = repair_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert got["audit"].count("K") + got["audit"].count("R") + got["audit"].count("D") >= 25


def test_a_long_conversation_is_linear():
    made = Repair()
    for k in range(20_000):
        made.add("user" if k % 3 else "assistant", f"{k}", k % 7 == 0, k % 5 == 0)
    cost, audit, _ = made.finish()
    assert len(audit.replace("I", "")) == 20_000 and cost > 0
