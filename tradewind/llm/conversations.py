"""Repair of conversations to an opening system turn, if any, and alternating user and assistant turns.

Every row of a conversation is kept, given another role, or deleted, and turns without text may be inserted, so that the
initials of the roles read (s?(ua)+)?. What an edit costs depends on the row's fault only, so a conversation is a
word of row codes (SIGNATURE), and the repairs are the paths through a directed acyclic graph of (place, state of
the pattern). The weight of a path is one whole number:

    cost * BASE^width + the edits' letters as digits of base BASE, first letter in the highest place.

Letters have digits in ASCII order and 0 stands after the last one, so the smaller number is the cheaper repair and, at equal cost, the
one whose letters are ASCII-least; a plain minimum over incoming edges decides everything. Weights are
taken from the end: an edge puts its letter on top of the weight of the rest, which moves down one place.

Conversations of any length. Rows are put into one global order once by a range sort (conversation, turn, role, hash of the text;
equal rows are cut anywhere), so a conversation with a third of all rows lies over many tasks. Its rows are
met in blocks of at most BLOCK places. A conversation inside a block is solved there. For one
that goes on beyond a block, each block gives the best weights between all pairs of states, and the conversation is solved over its blocks:
the same minimum with blocks as edges. A block's word of letters comes back to where its rows are.
Only two things of a conversation pass through one task, as the result holds them in one row: its letters, and the
running SHA-256 of its repaired text, which streams by in order and is never held.

Faults: the first of blank, duplicate, truncated counts. A duplicate is found by the smallest place per conversation,
role and SHA-256 of the text, added up before it is shuffled.

Nulls: null roles and texts are one space; null conversation ids are a conversation; null turns come first. Rows that
share a turn are ordered by role, then by a 64-bit hash of the text. Roles that do not begin with s, u or a (empty ones too) cannot be
kept. Conversations without rows after damage: zeros, no letters, hash of nothing. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import common
from tradewind.llm.vector_copies import grouped_batches
from tradewind.sources import scratch

#: Bits of a digit, and the digit of each letter, in ASCII order.
DIGIT = 3
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {v: k for k, v in DIGITS.items()}
ROLES = {"s": "system", "u": "user", "a": "assistant"}

#: Pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, ENDS = 4, (0, 3)
#: Row codes: a letter of the role (o: any other), small if sound, capital if truncated; x: blank or duplicate.
SIGNATURE = "suaoSUAOx"
#: As monotonically_increasing_id gives each task 2^33 places, a block never lies in two tasks.
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
#: More inserts than this in one gap would come back to a state of the pattern.
INSERTS = 2

NONE = -1


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def edges(code: str, costs: Costs) -> list[tuple[int, int, str, int]]:
    """(state, next state, letter, cost) of every edit of a row with this code."""
    out = [(q, q, "D", costs.delete) for q in range(STATES)]
    if code != "x":
        extra = costs.truncated if code.isupper() else 0
        own = code.lower()
        for (q, initial), after in STEPS.items():
            if initial == own:
                out.append((q, after, "K", costs.keep + extra))
            elif initial != "s":
                out.append((q, after, "R", costs.rerole + extra))
    return out


_INSERTS = [(q, after, "I") for (q, initial), after in STEPS.items() if initial != "s"]


def _edge_table(costs: Costs) -> dict[str, list[tuple[int, int, int, int]]]:
    return {c: [(q, after, DIGITS[x], cost) for q, after, x, cost in edges(c, costs)] for c in SIGNATURE}


def best_weights(signature: str, ends: dict[int, int], width: int, costs: Costs) -> list[int]:
    """For every state before the rows, the least weight of a path to the ends (state: weight); NONE without one."""
    low = DIGIT * width
    mask, top = (1 << low) - 1, low - DIGIT
    table = _edge_table(costs)

    def onward(weight: int, digit: int, cost: int) -> int:
        return ((weight >> low) + cost << low) | digit << top | (weight & mask) >> DIGIT

    def with_inserts(after: list[int]) -> list[int]:
        layer, found = after, list(after)
        for _ in range(INSERTS):
            grown = [NONE] * STATES
            for q, to, _ in _INSERTS:
                if layer[to] != NONE:
                    weight = onward(layer[to], DIGITS["I"], costs.insert)
                    if grown[q] == NONE or weight < grown[q]:
                        grown[q] = weight
            for q, weight in enumerate(grown):
                if weight != NONE and (found[q] == NONE or weight < found[q]):
                    found[q] = weight
            layer = grown
        return found

    after = with_inserts([ends.get(q, NONE) for q in range(STATES)])
    for code in reversed(signature):
        before = [NONE] * STATES
        for q, to, digit, cost in table[code]:
            if after[to] != NONE:
                weight = onward(after[to], digit, cost)
                if before[q] == NONE or weight < before[q]:
                    before[q] = weight
        after = with_inserts(before)
    return after


def room(rows: int, costs: Costs) -> int:
    """Letters that any best path over so many rows has at most: one a row, and inserts no dearer than deleting all
    rows, with the detour between any two states that a block may need."""
    return rows + (rows * costs.delete) // max(1, costs.insert) + 2 * INSERTS + 2


def letters_of(weight: int, width: int) -> str:
    out = []
    for i in range(width):
        digit = weight >> DIGIT * (width - 1 - i) & (1 << DIGIT) - 1
        if not digit:
            break
        out.append(LETTERS[digit])
    return "".join(out)


def solved(signature: str, costs: Costs = Costs()) -> tuple[int, str]:
    """(cost, letters) of the best repair of a whole conversation."""
    return _solved(signature, costs) if len(signature) <= 64 else _solved.__wrapped__(signature, costs)


@lru_cache(maxsize=1 << 17)
def _solved(signature: str, costs: Costs) -> tuple[int, str]:
    if len(signature) > BLOCK:
        cut = [signature[i : i + BLOCK] for i in range(0, len(signature), BLOCK)]
        cost, words = solved_over([(0, between(part, costs)) for part in cut])
        return cost, "".join(words)
    width = room(len(signature), costs)
    weight = best_weights(signature, dict.fromkeys(ENDS, 0), width, costs)[0]
    return weight >> DIGIT * width, letters_of(weight, width)


Paths = list[tuple[int, int, int, str]]


def between(signature: str, costs: Costs = Costs()) -> Paths:
    """(state before, state after, cost, letters) of the best path through a block for each pair of states.

    One path a pair is enough. Two words of equal cost and ends differ at some letter, whatever follows: if one
    began the other, what it lacks would be inserts only, and those cost something.
    """
    width = room(len(signature), costs)
    out = []
    for end in range(STATES):
        for q, weight in enumerate(best_weights(signature, {end: 0}, width, costs)):
            if weight != NONE:
                out.append((q, end, weight >> DIGIT * width, letters_of(weight, width)))
    return out


def solved_over(blocks: list[tuple[int, Paths]]) -> tuple[int, list[str]]:
    """(cost, the letters of each block) of the best path through blocks in order: the same minimum, blocks as edges."""
    width = sum(max(len(word) for *_, word in paths) for _, paths in blocks)
    low = DIGIT * width
    mask = (1 << low) - 1
    packed = {}

    def number(word: str) -> int:
        if word not in packed:
            packed[word] = int("".join(f"{DIGITS[x]:o}" for x in word) or "0", 8)
        return packed[word]

    after = {q: (0, ()) for q in ENDS}
    for _, paths in reversed(blocks):
        before: dict[int, tuple[int, tuple]] = {}
        for q, end, cost, word in paths:
            if end in after:
                rest, chain = after[end]
                n = len(word)
                weight = ((rest >> low) + cost << low) | number(word) << low - DIGIT * n | (rest & mask) >> DIGIT * n
                if q not in before or weight < before[q][0]:
                    before[q] = (weight, (word, chain))
        after = before
    weight, chain = after[0]
    words = []
    while chain:
        words.append(chain[0])
        chain = chain[1]
    return weight >> low, words


def walked(state: int, letters: str, codes: str) -> tuple[int, list[tuple[str | None, str]]]:
    """The state after the letters, and for each row and the end: (new initial or None if deleted, inserts before it).

    The letters and the codes of the rows leave one reading only: a state has at most one role to give but for the start,
    where s can only be kept.
    """
    out: list[tuple[str | None, str]] = []
    inserts, at = "", 0
    for letter in letters:
        if letter == "D":
            out.append((None, inserts))
        else:
            initial = codes[at].lower() if letter == "K" else ("a" if state == 2 else "u")
            state = STEPS[state, initial]
            if letter == "I":
                inserts += initial
                continue
            out.append((initial if letter == "R" else "", inserts))
        inserts, at = "", at + 1
    out.append((None, inserts))
    return state, out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that crc32(conv_id:turn) % 20 puts in."""
    rows = common.renamed_clear(conversations, ("conv_id", "turn", "role", "text"))
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return (
        rows.withColumn("fault", fault)
        .filter("fault <> 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
            F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def placed(rows: DataFrame) -> DataFrame:
    """rows in their global order, with place (rising; a task's places follow each other from a multiple of 2^33)."""
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    spread = rows.withColumn("__from", F.monotonically_increasing_id())  # cuts equal rows anywhere
    sorted_ = spread.repartitionByRange(
        common.shuffle_tasks(rows.sparkSession), *order, "__from"
    ).sortWithinPartitions(*order, "__from")
    return scratch.written(
        sorted_.drop("__from").withColumn("place", F.monotonically_increasing_id()), "conversation-rows"
    )


def row_codes(rows: DataFrame) -> DataFrame:
    """place, conv_id, initial, code, and mark: true for a second row of a place that is the first of its text."""
    # Java's and Python's idea of a space differ, so the set is named.
    visible = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    last = F.when(F.length(visible) > 0, F.substring(visible, -1, 1))
    initial = F.substring("role", 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(last.isNull(), "x").when(last.isin(".", "!", "?"), own).otherwise(F.upper(own))
    light = rows.select("place", "conv_id", initial.alias("initial"), code.alias("code"), F.lit(False).alias("mark"))
    first = (
        rows.filter(last.isNotNull())
        .groupBy("conv_id", "role", F.sha2("text", 256).alias("digest"))
        .agg(F.min("place").alias("place"))
        .select("place", "conv_id", F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("code"), F.lit(True).alias("mark"))
    )
    return light.unionByName(first)


PART = (
    "conv_id {kind}, block bigint, at bigint, codes string, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, first string, last string, whole boolean, cost bigint, audit string, "
    "paths array<struct<a:int,b:int,cost:bigint,word:string>>"
)


def parts(rows: DataFrame, costs: Costs) -> DataFrame:
    """One row per conversation and block: PART. whole: solved here; else paths has its best weights."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["conv_id"]
    light = row_codes(rows).withColumn("block", F.shiftright("place", BLOCK_BITS))
    ordered = light.repartition(common.shuffle_tasks(spark), "block").sortWithinPartitions("block", "place", F.desc("mark"))
    schema = PART.format(kind=kind)
    target = common.to_arrow(spark.createDataFrame([], schema).schema)

    def segments(table: pa.Table) -> list[dict]:
        place = table.column("place").to_numpy()
        mark = table.column("mark").to_numpy(zero_copy_only=False)
        real = np.flatnonzero(~mark)
        sole = set(place[mark].tolist())
        take = table.take(pa.array(real))
        conv, initial, code = (take.column(c).to_pylist() for c in ("conv_id", "initial", "code"))
        place = place[real].tolist()
        out = []
        start = 0
        for i in range(1, len(real) + 1):
            if i < len(real) and conv[i] == conv[start]:
                continue
            own = range(start, i)
            codes, counts = [], [0, 0, 0]
            for j in own:
                c = code[j]
                if c == "x":
                    counts[0] += 1
                elif place[j] not in sole:
                    c = "x"
                    counts[1] += 1
                elif c.isupper():
                    counts[2] += 1
                codes.append(c)
            pairs = zip(initial[start:i], initial[start + 1 : i])
            whole = 0 < start and i < len(real)
            word = "".join(codes)
            cost, audit = solved(word, costs) if whole else (None, None)
            out.append(
                {
                    "conv_id": conv[start], "block": place[start] >> BLOCK_BITS, "at": place[start], "codes": word,
                    "blank": counts[0], "duplicate": counts[1], "truncated": counts[2],
                    "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs),
                    "first": initial[start], "last": initial[i - 1], "whole": whole, "cost": cost, "audit": audit,
                    "paths": [] if whole else [
                        {"a": a, "b": b, "cost": c, "word": w} for a, b, c, w in between(word, costs)
                    ],
                }
            )
            start = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["block"]):
            yield from pa.Table.from_pylist(segments(table), schema=target).to_batches()

    return scratch.written(ordered.mapInArrow(run, schema), "conversation-parts")


WORD = "conv_id {kind}, at bigint, codes string, letters string, state int"
FACTS = "conv_id {kind}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def joined_parts(own: DataFrame) -> DataFrame:
    """WORD and FACTS columns of the conversations that go on beyond a block: a row per part, facts on its first."""
    spark = own.sparkSession
    kind = dict(own.dtypes)["conv_id"]
    schema = WORD.format(kind=kind) + ", " + FACTS.format(kind=kind).split(", ", 1)[1]
    target = common.to_arrow(spark.createDataFrame([], schema).schema)
    open_ = own.filter("not whole").drop("whole", "cost", "audit", "block")
    # Its parts are as many as its blocks; Spark's own null-safe grouping key keeps a null id apart.
    ordered = open_.repartition(common.shuffle_tasks(spark), "conv_id").sortWithinPartitions("conv_id", "at")

    def finished(group: list[dict]) -> pa.Table:
        blocks = [(0, [(p["a"], p["b"], p["cost"], p["word"]) for p in g["paths"]]) for g in group]
        cost, words = solved_over(blocks)
        seams = sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in zip(group, group[1:]))
        out, state = [], 0
        for g, word in zip(group, words):
            out.append({"conv_id": g["conv_id"], "at": g["at"], "codes": g["codes"], "letters": word, "state": state})
            state, _ = walked(state, word, g["codes"])
        total = {c: sum(g[c] for g in group) for c in ("blank", "duplicate", "truncated", "illegal")}
        out[0] |= total | {"illegal": total["illegal"] + seams, "cost": cost, "audit": "".join(words)}
        return pa.Table.from_pylist(out, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and row["conv_id"] != group[0]["conv_id"]:
                    yield from finished(group).to_batches()
                    group = []
                group.append(row)
        if group:
            yield from finished(group).to_batches()

    return scratch.written(ordered.mapInArrow(run, schema), "conversation-words")


def repaired_hashes(rows: DataFrame, words: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: rows and their letters stream by in order, a conversation's hash grows line by line."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["conv_id"]
    letters = words.select(
        "conv_id", F.col("at").alias("place"), F.lit(0).alias("row"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), "codes", "letters", "state",
    )
    none = {c: F.lit(None).cast("string").alias(c) for c in ("codes", "letters")}
    texts = rows.select(
        "conv_id", "place", F.lit(1).alias("row"), "role", "text", *none.values(), F.lit(None).cast("int").alias("state")
    )
    ordered = letters.unionByName(texts).repartition(common.shuffle_tasks(spark), "conv_id").sortWithinPartitions(
        "conv_id", "place", "row"
    )
    schema = f"conv_id {kind}, repaired_sha256 string"
    target = common.to_arrow(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, empty, current, started = hashlib.sha256(), True, None, False
        plan: list[tuple[str | None, str]] = []
        at = 0

        def line(role: str, text: str) -> None:
            nonlocal empty
            digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False

        def inserted(initials: str) -> None:
            for x in initials:
                line(ROLES[x], "")

        for batch in batches:
            ids, hashes = [], []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "row", "role", "text", "codes", "letters", "state")]
            for conv, row, role, text, codes, word, state in zip(*columns):
                if not row:
                    if plan:
                        inserted(plan[-1][1])
                    if started and conv != current:
                        ids.append(current)
                        hashes.append(digest.hexdigest())
                        digest, empty = hashlib.sha256(), True
                    current, started = conv, True
                    _, plan = walked(state, word, codes)
                    at = 0
                else:
                    new, before = plan[at]
                    at += 1
                    inserted(before)
                    if new is not None:
                        line(ROLES[new] if new else role, text)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, target.field(0).type), pa.array(hashes)], schema=target)
        if started:
            inserted(plan[-1][1])
            yield pa.RecordBatch.from_arrays([pa.array([current], target.field(0).type), pa.array([digest.hexdigest()])], schema=target)

    return ordered.mapInArrow(run, schema)


def repaired(original: DataFrame, rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repair of rows (conv_id, turn, role, text), with a row for every conv_id of original."""
    stored = placed(rows)
    own = parts(stored, costs)
    beyond = joined_parts(own)
    words = own.filter("whole").select(
        "conv_id", "at", "codes", F.col("audit").alias("letters"), F.lit(0).alias("state")
    ).unionByName(beyond.select("conv_id", "at", "codes", "letters", "state"))
    facts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    counts = own.filter("whole").select("conv_id", *facts).unionByName(
        beyond.filter("audit is not null").select("conv_id", *facts)
    )
    spans = stored.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    everyone = common.renamed_clear(original, ("conv_id",)).distinct()
    empty = hashlib.sha256().hexdigest()
    # One grouping in place of four joins; it also keeps a null id.
    pieces = [everyone, counts, spans, repaired_hashes(stored, words)]
    together = pieces[0]
    for piece in pieces[1:]:
        together = together.unionByName(piece, allowMissingColumns=True)
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return together.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in zeros],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations")
    return repaired(conversations, damaged(conversations))
