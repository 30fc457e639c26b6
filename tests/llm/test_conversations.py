"""Conversation repair against a search over all audits, and long conversations against the same in one block."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from framelake.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conversations with their rows after damage, in order)."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if hit == 1:
            text = ""
        elif hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif hit == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def by_hand(turns, insert=5):
    """Every end after each turn keeps its least (cost, audit, turns), the audits as strings; inserts may come anywhere."""
    seen, faults = set(), []
    for _, role, text in turns:
        solid = [c for c in text if c not in BLANKS]
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def put(states, end, new):
        if end not in states or new < states[end]:
            states[end] = new

    def inserted(states):
        for _ in range(3):
            for end, (cost, audit, left) in list(states.items()):
                for x in allowed[end]:
                    if x != "s":
                        put(states, x, (cost + insert, audit + "I", (*left, f"{full[x]}:")))
        return states

    states = {"": (0, "", ())}
    for (_, role, text), fault in zip(turns, faults, strict=True):
        new = {}
        for end, (cost, audit, left) in inserted(states).items():
            put(new, end, (cost + 2, audit + "D", left))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            for x in allowed[end]:
                if role[:1] == x:
                    put(new, x, (cost + more, audit + "K", (*left, f"{role}:{text}")))
                if x != "s":
                    put(new, x, (cost + 1 + more, audit + "R", (*left, f"{full[x]}:{text}")))
        states = new
    cost, audit, left = min(v for end, v in inserted(states).items() if end in ("", "a"))
    times = [t for t, _, _ in turns if t is not None]
    gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
    heads = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest(), left)


def random_rows(seed, conversations_, length, odd=True):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "user", "assistant", *(["User", "", "umpire", None, "tool"] if odd else [])]
    texts = ["Yes.", "no", "Why?", "wait!", "", " \t", "Well. ", "So", *([None, "é.", "x\ny.", " "] if odd else [])]
    rows = []
    for c in range(conversations_):
        for t in range(int(rng.integers(1, length))):
            turn = None if rng.random() < 0.05 else int(t + 3 * (rng.random() < 0.1))
            role = ("user", "assistant")[t % 2] if rng.random() < 0.5 else roles[rng.integers(len(roles))]
            text = f"Turn {rng.integers(40)}." if rng.random() < 0.5 else texts[rng.integers(len(texts))]
            rows.append((None if c == 3 else c, turn, role, text))
    return [*rows, rows[0], rows[0], rows[-1]]


def held(spark, rows, partitions=3, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as cost", "1 as at", "'y' as kind", "2 as back").repartition(partitions)
    got = conversations.repair(conversations.damage(df), **options).collect()
    want = {c: by_hand(turns) for c, turns in damaged(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]][:-1], r["conv_id"]
    return want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_is_the_cheapest_and_least_audit(spark, seed):
    rows = random_rows(seed, 60, 14)
    want = held(spark, rows)
    assert {"D", "K", "R"} <= {x for w in want.values() for x in w[6]}


def test_inserts_where_they_are_cheap(monkeypatch):
    """At a cost of 5 a deletion always beats an insert, so the codes with inserts are tried at a cost of 1."""
    monkeypatch.setattr(conversations, "INSERT", 1)
    monkeypatch.setattr(conversations, "_COSTS", conversations._table())
    rng = np.random.default_rng(3)
    for _ in range(200):
        turns = [(t, rng.choice(["user", "assistant", "system"]), f"{t}{rng.choice(['.', ''])}" if rng.random() < 0.8 else "") for t in range(int(rng.integers(1, 9)))]
        symbol = np.array([{"s": 1, "u": 2, "a": 3}[r[0]] for _, r, _ in turns])
        kind = np.array([1 if not x else 0 if x[-1] == "." else 2 for _, _, x in turns])
        cost, rank, back = conversations.solve(symbol, kind, np.array([0, len(turns)]))
        ends = [(int(cost[0, 0, e]) + k, int(rank[0, 0, e]), k, e) for e in range(4) for k in range(3) if conversations._after(e, k) in (0, 3)]
        total, _, tail, end = min(ends)
        audit = "".join(conversations.CODES[c] for _, c in conversations.walk(back.tobytes(), 0, end)) + "I" * tail
        assert (total, audit) == by_hand(turns, insert=1)[5:7]


def test_conversations_over_many_blocks(spark):
    """Blocks of four rows: every conversation of more turns is chained."""
    held(spark, random_rows(7, 25, 40), 5, bits=2)


def test_a_long_conversation_lies_in_many_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "user", f"Text {rng.integers(9000)}" + "." * int(rng.random() < 0.9)) for t in range(20_000)] + [(2, 0, "user", "One."), (2, 1, "assistant", "Two.")]
    held(spark, rows)


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = random_rows(5, 30, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    own = defaultdict(list)
    for r in sorted(conversations.repaired_turns(conversations.damage(df)).collect(), key=lambda r: (r["at"], r["part"])):
        own[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for c, turns in damaged(rows).items():
        assert tuple(own[c]) == by_hand(turns)[-1]


def test_no_rows_and_nothing_left(spark):
    assert conversations.repair(conversations.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (r,) = conversations.repair(conversations.damage(spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA))).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_faults_of_the_extremes(spark):
    """Turns at both ends of a long: gaps are held at the greatest."""
    rows = [(c, t, "user", "A.") for c in range(6) for t in (-(1 << 63), (1 << 63) - 1)]
    got = {r["conv_id"]: r["gaps"] for r in conversations.repair(conversations.damage(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = {c: min(by_hand(t)[0], (1 << 63) - 1) for c, t in damaged(rows).items()}
    assert got == want
