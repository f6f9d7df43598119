"""Conversation repair against a dynamic program and a plain loop, and odd rows."""

import hashlib
import random
import re
import zlib
from itertools import product

from labelforge.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WANTED = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def table_best(rows):
    """(cost, audit, repaired) by a table over rows and the role before; rows: (role, text, fault)."""

    def offer(new, state, entry):
        if state not in new or entry[:2] < new[state][:2]:
            new[state] = entry

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, out) in list(states.items()):
                offer(states, AFTER[state, WANTED[state][0]], (cost + 2, audit + "I", (*out, (WANTED[state], ""))))
        return states

    best = inserted({"": (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, out) in best.items():
            offer(new, state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cost += fault == "truncated"
            if (state, role[:1]) in AFTER:
                offer(new, AFTER[state, role[:1]], (cost, audit + "K", (*out, (role, text))))
            offer(new, AFTER[state, WANTED[state][0]], (cost + 2, audit + "R", (*out, (WANTED[state], text))))
        best = inserted(new)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows, originals):
    """The contract, row by row."""
    out = {}
    for conv in {r[0] for r in originals}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in mine if t is not None]
        seen, judged = set(), []
        for _, role, text in mine:
            visible = VISIBLE.findall(text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        cost, audit, repaired = table_best(judged)
        initials = [r[:1] for r, _, _ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def repaired(spark, rows, originals=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return got(conversations.repair(df, spark.createDataFrame(originals or rows, SCHEMA)))


def random_rows(n, seed, convs=40):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t\n", "same", "same.", "é…", "Ende.  \n", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "unicorn", None]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_search_finds_the_cheapest_and_least_edits():
    kinds = [("system", "x.", ""), ("user", "x.", ""), ("assistant", "x.", ""), ("tool", "x", "truncated"), ("user", "", "blank"), ("assistant", "x", "truncated")]
    code = {"s": 0, "u": 1, "a": 2}
    fault = {"blank": 0, "duplicate": 1, "truncated": 2, "": 3}
    for n in range(5):
        for rows in product(kinds, repeat=n):
            want = table_best(rows)
            assert conversations.cheapest([4 * code.get(r[0], 3) + fault[f] for r, _, f in rows]) == want[:2], rows


def test_a_long_conversation_takes_time_in_proportion():
    rng = random.Random(1)
    codes = bytes(rng.randrange(16) for _ in range(100_000))
    cost, audit = conversations.cheapest(codes)
    assert len(audit.replace("I", "")) == len(codes) and cost > 0


def test_repair_is_that_of_a_loop(spark):
    rows = random_rows(900, 2)
    assert repaired(spark, rows) == brute(rows, rows)


def test_one_conversation_holds_a_third_of_all_rows(spark):
    rows = random_rows(600, 3) + [(1000, t, random.Random(t).choice(["user", "assistant"]), f"text {t % 7}.") for t in range(300)]
    assert repaired(spark, rows) == brute(rows, rows)


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"Text {c}, {t}! And more.") for c in range(200) for t in range(1 + c % 3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    damaged = [tuple(r) for r in conversations.damage(df).collect()]
    assert sorted(map(str, damaged)) == sorted(map(str, hurt(rows)))
    want = brute(hurt(rows), rows)
    assert any(w == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for w in want.values())
    assert got(conversations.repair(conversations.damage(df), df)) == want


def test_repaired_turns_and_odd_columns(spark):
    rows = [(7, None, "user", "Hi."), (7, 2, "user", "Again."), (8, 1, "assistant", "Only me"), (None, 1, "system", "Be kind."), (9, 1, "user", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, fault int, tie string")
    plans = conversations.plan(df)
    turns = [(r.conv_id, r.place, r.edit, r.role, r.text) for r in conversations.repaired(df, plans).collect()]
    assert sorted(turns) == [(7, 0, "K", "user", "Hi."), (7, 1, "R", "assistant", "Again.")]
    assert got(conversations.repair(df, df)) == brute(rows, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(df, df).collect() == []
    assert conversations.repaired(df, conversations.plan(df)).collect() == []


def test_query(spark):
    df = queries.QUERIES["op11_conversations"](spark, "/root/testdata/sf0.001")
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")] == ["bigint"] * 7 + ["string"] * 2
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == brute(hurt(rows), rows)
