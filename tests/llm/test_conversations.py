"""Conversation repair against a brute-force version that compares (cost, letters) as they are."""

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import conversations as c
from tradewind.llm.queries import queries

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(x for x in text if x not in ".!?")
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def best_by_hand(rows):
    """rows: (initial, must be deleted, truncated). (cost, letters, [(row or None, role initial)])"""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserts < 3:
            for x in "ua":
                if (state, x) in steps:
                    rest = best(i, steps[state, x], inserts + 1)
                    if rest:
                        found.append((rest[0] + 5, "I" + rest[1], ((None, x),) + rest[2]))
        if i < len(rows):
            initial, gone, truncated = rows[i]
            rest = best(i + 1, state, 0)
            if rest:
                found.append((rest[0] + 2, "D" + rest[1], rest[2]))
            for x in "sua":
                if not gone and (state, x) in steps and (x == initial or x != "s"):
                    rest = best(i + 1, steps[state, x], 0)
                    if rest:
                        letter, cost = ("K", 0) if x == initial else ("R", 1)
                        found.append((rest[0] + cost + 5 * truncated, letter + rest[1], ((i, x if letter == "R" else None),) + rest[2]))
        return min(found, key=lambda f: f[:2], default=None)

    return best(0, 0, 0)


def repaired_by_hand(original, rows):
    groups = {r[0]: [] for r in original}
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for conv, own in groups.items():
        own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            last = text.rstrip(SPACES)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            faults.append(fault)
        turns = {r[1] for r in own if r[1] is not None}
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = best_by_hand([(x, f in (0, 1), f == 2) for x, f in zip(initials, faults)])
        names = {"u": "user", "a": "assistant"}
        lines = [
            f"{names[x]}:" if i is None else f"{names[x] if x else own[i][2]}:{own[i][3]}" for i, x in kept
        ]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[x] for x in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(seed, conversations, longest):
    random = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "usher", "User"]
    texts = ["Yes.", "No!", "and so", "", None, " \n", "Why?", "é.", "one. two", "end.\t"]
    out = []
    for conv in range(conversations):
        for turn in range(int(random.integers(1, longest))):
            clean = random.random() < 0.6
            role = ["user", "assistant"][turn % 2] if clean else roles[random.integers(len(roles))]
            text = f"text {random.integers(1000)}." if clean else texts[random.integers(len(texts))]
            out.append((conv, turn if random.random() < 0.95 else None, role, text))
    return out


def test_repair_is_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    original = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(queries()["op12_conversation_repair"](spark, small)) == repaired_by_hand(original, damaged_by_hand(original))


@pytest.mark.parametrize("bits", [2, 5, c.BLOCK_BITS])
def test_repair_of_bad_conversations_in_small_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(c, "BLOCK_BITS", bits)
    # null turns tie: one row each, so that no order among them is left open
    rows = {(r[0], r[1]): r for r in random_rows(1, 300, 12)}
    rows = list(rows.values()) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello.")]
    rows += [(9_000, 0, "user", "Hi.")] * 7 + [(9_001, None, None, None)] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("place", "block", "code", "audit", "copy")})
    assert found(c.repaired(df, df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))) == (
        repaired_by_hand(rows, [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in rows])
    )
    assert found(c.repaired(df, c.damaged(df))) == repaired_by_hand(rows, damaged_by_hand(rows))


def test_a_conversation_with_most_rows_lies_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BITS", 3)
    rows = [(5, i, ["user", "assistant"][i % 2] if i % 7 else "tool", f"turn {i}." if i % 11 else "same") for i in range(220)]
    rows += [(1, 0, "user", "A."), (9, 0, "assistant", "B.")] + [(6, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(c.repaired(df, df)) == repaired_by_hand(rows, rows)


def test_repair_of_nothing(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert c.repaired(nothing, c.damaged(nothing)).count() == 0
    some = spark.createDataFrame([(3, 1, "user", "a")], SCHEMA)
    empty = hashlib.sha256().hexdigest()
    assert found(c.repaired(some, some.limit(0))) == {3: (0, 0, 0, 0, 0, 0, "", empty)}


def test_weights_of_words_and_of_blocks_agree():
    random = np.random.default_rng(3)
    for _ in range(200):
        word = "".join(random.choice(list(c.SIGNATURE), random.integers(0, 14)))
        rows = [(x.lower() if x != "x" else "u", x == "x", x.isupper()) for x in word]
        whole = c.solved(word)
        assert whole == best_by_hand(rows)[:2]
        cuts = sorted(random.integers(0, len(word) + 1, 2))
        blocks = [word[: cuts[0]], word[cuts[0] : cuts[1]], word[cuts[1] :]]
        cost, words = c.solved_over([(0, c.between(b)) for b in blocks])
        assert (cost, "".join(words)) == whole


def test_inserts_are_chosen_when_they_are_cheap():
    costs = c.Costs(delete=9, rerole=9, insert=1)
    assert c.solved("ua", costs) == (0, "KK")
    assert c.solved("uu", costs) == (2, "KIKI")
    assert c.solved("sa", costs) == (1, "KIK")
    cost, words = c.solved_over([(0, c.between("s", costs)), (0, c.between("a", costs))])
    assert (cost, "".join(words)) == (1, "KIK")
