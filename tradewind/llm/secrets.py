"""Secret scans: fixed patterns, and a linear-chain conditional random field over words.

The field tags every word as the beginning of a secret, inside one, or outside. A word's score comes from
its shape, the shapes of its neighbours and features of the file it stands in; transitions between
tags have scores of their own; Viterbi's best path decides. Words with the same features share their
scores, so scoring a text is a lookup per word. Wherever "outside" leads by more than any change of
the neighbouring transitions could win back, every best path passes through "outside"; the text is
cut there and only the stretches between are decoded, with the same result as decoding it whole.

The field is trained here, on the stretches around pattern matches (tags from the patterns) and on
stretches without any, of at most about SAMPLE_DOCS documents chosen by a hash of their id and at most
SEGMENTS stretches of SEGMENT words. Its spans are added to those of the patterns where they do not
overlap them.

Null and empty texts have no spans. Repeated rows get the same spans each. If the sample holds no
match, the field adds nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm import common
from tradewind.sources import scratch

# The base patterns, in the order in which spans that start together are listed.
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18
#: Characters that a span of the field needs.
LEAST_ADDED = 12
NAMES = ("password", "passwd", "secret", "token", "api")

SAMPLE_DOCS = 5_000
SEGMENTS = 2_000
SEGMENT = 48
CACHE_WORDS = 1_000_000
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns; a match that is too short still uses up its characters."""
    out = []
    lower = text.lower()
    if any(name in lower for name in NAMES):
        out += [
            (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED
        ]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- features ---------------------------------------------------------------------------------------------

FEATURES = (
    *[f"chars<{n}" for n in (3, 5, 8, 12, 16, 20, 32, 64)], "long",
    "lower", "title", "upper", "mixed", "no_letter",
    "digits", "some_digits", "half_digits", "hex", "secret_letters", "upper_digit", "all_classes",
    "changes<2", "changes<5", "changes<10", "changes",
    "name", "assigned", "ends_assigned", "quoted", "at", "slash", "dot", "key_start", "marks", "ends_mark", "figures",
)
FEATURE = {name: i for i, name in enumerate(FEATURES)}
FILE_FEATURES = ("always", "short", "long", "symbols", "digits", "markup")

_SECRET = re.compile(r"[A-Za-z0-9+/_.=-]+")
_HEX = re.compile(r"(?=.*[0-9])[0-9a-f]+")
_CHANGE = re.compile(r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]")
_EDGE = "\"'`,;:.!?()[]{}<>*#$%&|"


def word_features(word: str) -> tuple[int, ...]:
    """Numbers of the FEATURES that a word has."""
    core = word.strip(_EDGE) or word
    n = len(core)
    found = [next((f"chars<{k}" for k in (3, 5, 8, 12, 16, 20, 32, 64) if n < k), "long")]
    if core.isalpha():
        found.append("lower" if core.islower() else "upper" if core.isupper() else "title" if core.istitle() else "mixed")
    else:
        digits = sum(map(str.isdigit, core))
        upper, lower = any(map(str.isupper, core)), any(map(str.islower, core))
        found.append("mixed" if upper and lower else "upper" if upper else "lower" if lower else "no_letter")
        if digits:
            found.append("digits" if digits == n else "half_digits" if 2 * digits >= n else "some_digits")
            if _HEX.fullmatch(core):
                found.append("hex")
            if not (upper or lower) and digits < n:
                found.append("figures")  # an address, a date, a price
            if upper and not lower:
                found.append("upper_digit")
            if upper and lower:
                found.append("all_classes")
        changes = sum(1 for _ in _CHANGE.finditer(core))
        found.append(next((f"changes<{k}" for k in (2, 5, 10) if changes < k), "changes"))
        for name, mark in (("at", "@"), ("slash", "/"), ("dot", "."), ("marks", "|")):
            if mark in core:
                found.append(name)
        if "=" in core or ":" in core:
            found.append("assigned")
    if _SECRET.fullmatch(core):
        found.append("secret_letters")
    lower = word.lower()
    if any(name in lower for name in NAMES):
        found.append("name")
    if word[-1] in "=:":
        found.append("ends_assigned")
    elif word[-1] in ".,;!?":
        found.append("ends_mark")
    if word[0] in "\"'" or word[-1] in "\"'":
        found.append("quoted")
    if core.startswith("AKIA"):
        found.append("key_start")
    return tuple(sorted({FEATURE[f] for f in found}))


def file_features(text: str, n_words: int) -> np.ndarray:
    """Which FILE_FEATURES a text has, as 0 and 1."""
    n = max(1, n_words)
    return np.array(
        [
            1.0,
            n < 100,
            n > 1_000,
            sum(map(text.count, "#*$%&|")) > n / 5,
            sum(map(text.count, "0123456789")) > n / 4,
            text.count("<") > n / 20,
        ],
        float,
    )


class Shapes:
    """Numbers for sets of word features, and the number of each word's set."""

    def __init__(self):
        self.sets: dict[tuple[int, ...], int] = {}
        self.words: dict[str, int] = {}

    def numbers(self, found: list[str]) -> np.ndarray:
        known = self.words
        out = np.empty(len(found), np.int64)
        for i, word in enumerate(found):
            number = known.get(word)
            if number is None:
                own = word_features(word)
                number = self.sets.setdefault(own, len(self.sets))
                if len(known) < CACHE_WORDS and len(word) <= 64:
                    known[word] = number
            out[i] = number
        return out

    def of_sets(self, found: list[list[int]]) -> np.ndarray:
        return np.array([self.sets.setdefault(tuple(own), len(self.sets)) for own in found], np.int64)

    def matrix(self) -> np.ndarray:
        """A row of 0 and 1 for each set."""
        out = np.zeros((len(self.sets), len(FEATURES)))
        for own, number in self.sets.items():
            out[number, list(own)] = 1
        return out


# --- the field --------------------------------------------------------------------------------------------


class Field:
    """Weights: words (own, previous, next) x FEATURES x tags, files x tags, transitions between tags."""

    def __init__(self, words: np.ndarray, files: np.ndarray, moves: np.ndarray):
        self.words, self.files, self.moves = words, files, moves

    @classmethod
    def untrained(cls) -> "Field":
        words, files = np.zeros((3, len(FEATURES), 3)), np.zeros((len(FILE_FEATURES), 3))
        files[0] = (3.0, 0.0, 0.0)
        return cls(words, files, np.array([[0.0, 0.0, -6.0], [0.0, -2.0, 0.0], [0.0, -2.0, 0.0]]))

    def scores(self, own: np.ndarray, prev: np.ndarray, nxt: np.ndarray, files: np.ndarray) -> np.ndarray:
        """Scores by tag from 0/1 rows of features."""
        return own @ self.words[0] + prev @ self.words[1] + nxt @ self.words[2] + files @ self.files

    def lead(self) -> float:
        """More than this, and no change of the tags beside a word can make up for leaving "outside"."""
        m = self.moves
        enter = (m[:, 1:] - m[:, :1]).max()  # from any tag into one of a secret, against outside
        leave = (m[1:, :] - m[:1, :]).max()
        return max(0.0, float(enter)) + max(0.0, float(leave))


def viterbi(scores: np.ndarray, moves: np.ndarray, before: int | None = None, after: int | None = None) -> np.ndarray:
    """The best path of tags, between fixed tags before and after if there are any."""
    best = scores[0] + (moves[before] if before is not None else 0)
    back = []
    for own in scores[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + own
    tag = int((best + (moves[:, after] if after is not None else 0)).argmax())
    path = [tag]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def best_tags(scores: np.ndarray, field: Field) -> np.ndarray:
    """viterbi over all of scores, decoding only between words that must be outside."""
    tags = np.zeros(len(scores), np.int64)
    unsure = scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) <= field.lead()
    sides = np.flatnonzero(np.diff(np.r_[False, unsure, False].astype(np.int8)))
    for start, end in zip(sides[::2], sides[1::2]):
        before = OUTSIDE if start else None
        after = OUTSIDE if end < len(scores) else None
        tags[start:end] = viterbi(scores[start:end], field.moves, before, after)
    return tags


def trained(segments: list[dict], rounds: int = 120, penalty: float = 0.02) -> Field:
    """A field fitted to segments (features, tags, file) by gradient steps on the likelihood."""
    shapes = Shapes()
    rows = [(shapes.of_sets(s["features"]), np.array(s["tags"]), np.array(s["file"])) for s in segments if s["features"]]
    field = Field.untrained()
    if not rows or not any((t > 0).any() for _, t, _ in rows):
        return field
    n, width = len(rows), max(len(x) for x, _, _ in rows)
    features = np.r_[shapes.matrix(), np.zeros((1, len(FEATURES)))]  # the last row: no word
    blank = len(features) - 1
    own = np.full((n, width), blank)
    tags, real = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for i, (x, t, _) in enumerate(rows):
        own[i, : len(x)], tags[i, : len(x)], real[i, : len(x)] = x, t, True
    side = np.full((n, 1), blank)
    sides = (own, np.c_[side, own[:, :-1]], np.c_[own[:, 1:], side])
    files = np.stack([f for _, _, f in rows])
    truth = np.eye(3)[tags] * real[:, :, None]
    both = real[:, 1:]
    true_moves = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    weights = [field.words, field.files, field.moves]
    steps = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for round_ in range(1, rounds + 1):
        table = features @ field.words  # (3, sets, tags)
        scores = sum(table[i][x] for i, x in enumerate(sides)) + (files @ field.files)[:, None, :]
        alpha, beta = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        alpha[:, 0] = scores[:, 0]
        for t in range(1, width):
            grown = _log_sum(alpha[:, t - 1, :, None] + field.moves, 1) + scores[:, t]
            alpha[:, t] = np.where(real[:, t, None], grown, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            grown = _log_sum(field.moves + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], grown, beta[:, t + 1])
        total = _log_sum(alpha[:, -1], 1)
        chance = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        pair = alpha[:, :-1, :, None] + field.moves + (scores[:, 1:] + beta[:, 1:])[:, :, None, :]
        pairs = (np.exp(pair - total[:, None, None, None]) * both[:, :, None, None]).sum(axis=(0, 1))
        rest = truth - chance
        by_set = np.zeros((3, len(features), 3))
        for i, x in enumerate(sides):
            np.add.at(by_set[i], x.ravel(), rest.reshape(-1, 3))
        gradients = [features.T @ by_set, files.T @ rest.sum(axis=1), true_moves - pairs]
        for weight, gradient, (mean, square) in zip(weights, gradients, steps):
            gradient = gradient / n - penalty * weight / n**0.5
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            weight += 0.1 * (mean / (1 - 0.9**round_)) / (np.sqrt(square / (1 - 0.99**round_)) + 1e-8)
    return field


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


# --- training stretches -----------------------------------------------------------------------------------


def word_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def training_segments(text: str) -> list[dict]:
    """Stretches of SEGMENT words around the pattern matches, and one elsewhere, with tags from the patterns."""
    places = word_places(text)
    if not places:
        return []
    found = pattern_spans(text)
    tags = np.zeros(len(places), np.int64)
    starts = np.array([a for a, _ in places])
    for start, end, _ in found:
        a = max(0, int(np.searchsorted(starts, start, side="right")) - 1)
        b = int(np.searchsorted(starts, end, side="left"))
        inside = tags[a:b] > 0
        tags[a:b] = np.where(inside, tags[a:b], INSIDE)
        if not inside[0]:
            tags[a] = BEGIN
    file = file_features(text, len(places)).tolist()
    hits = np.flatnonzero(tags == BEGIN)
    middles = hits[np.r_[True, np.diff(hits) > SEGMENT]].tolist() if len(hits) else []
    out = []
    for middle in [*middles, (len(text) * 7919) % len(places)]:
        a = max(0, middle - SEGMENT // 2)
        own = places[a : a + SEGMENT]
        out.append(
            {
                "features": [list(word_features(text[i:j])) for i, j in own],
                "place": xxhash.xxh64_intdigest(text[own[0][0] : own[-1][1]].encode()) - (1 << 63),
                "tags": tags[a : a + SEGMENT].tolist(),
                "file": file,
            }
        )
    return out


def drawn(docs: DataFrame, sample_docs: int) -> DataFrame:
    """text of the at most sample_docs different rows (id and text) with the smallest hashes; of any table but an empty one, some."""
    hashed = common.renamed_clear(docs, ("doc_id", "text")).withColumn("row", F.xxhash64("doc_id", "text"))
    smallest = hashed.select("row").distinct().orderBy("row").limit(sample_docs).agg(F.max("row")).first()[0]
    return hashed.filter(F.col("row") <= F.lit(smallest)).dropDuplicates(["row"]).select("text")


def fitted(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, segments: int = SEGMENTS) -> Field:
    """The field trained on a bounded sample; both bounds are given."""

    def rows(batch: dict) -> dict:
        found = [s for text in batch["text"] for s in training_segments(text or "")]
        return {
            **{k: [s[k] for s in found] for k in ("features", "tags", "file", "place")},
            "some": [max(s["tags"]) > 0 for s in found],
        }

    cut = scratch.written(
        common.arrow_map(
            drawn(docs, sample_docs), rows,
            "features array<array<int>>, tags array<int>, file array<double>, place bigint, some boolean",
        ),
        "secret-segments",
    )
    own = [
        cut.filter(F.col("some") == flag).orderBy("place", "features", "tags", "file").limit(segments // 2).collect()
        for flag in (True, False)
    ]
    return trained([r.asDict() for part in own for r in part])


# --- scanning ---------------------------------------------------------------------------------------------


class Scanner:
    def __init__(self, field: Field):
        self.field, self.shapes = field, Shapes()
        self.tables, self.rows = np.zeros((3, 0, 3)), 0

    def field_spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets the field tags, without quotes and marks around them."""
        found = text.split()
        if not found:
            return []
        numbers = self.shapes.numbers(found)
        if len(self.shapes.sets) > self.rows:
            self.tables, self.rows = self.shapes.matrix() @ self.field.words, len(self.shapes.sets)
        scores = self.tables[0][numbers] + file_features(text, len(found)) @ self.field.files
        scores[1:] += self.tables[1][numbers[:-1]]
        scores[:-1] += self.tables[2][numbers[1:]]
        tags = best_tags(scores, self.field)
        if not tags.any():
            return []
        out, places = [], word_places(text)
        for at in np.flatnonzero(tags).tolist():
            start, end = places[at]
            word = text[start:end]
            start += len(word) - len(word.lstrip(_EDGE))
            end -= len(word) - len(word.rstrip(_EDGE))
            if end <= start:
                continue
            if tags[at] == INSIDE and at and tags[at - 1] and out:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
        return [s for s in out if s[1] - s[0] >= LEAST_ADDED]

    def spans(self, text: str | None) -> tuple[list, list]:
        """Spans of the patterns, and all spans, as (start, end, kind) by start, then kind as listed."""
        base = pattern_spans(text or "")
        added = [
            (a, b, "crf") for a, b in self.field_spans(text or "") if not any(a < y and x < b for x, y, _ in base)
        ]
        return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: The worker's scanner with its word cache; that of an earlier field goes when another comes.
_SCANNERS: dict[str, Scanner] = {}


def scanner(name: str, field: Field) -> Scanner:
    common.claim(_SCANNERS)
    if name not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name] = Scanner(field)
    return _SCANNERS[name]


def scanned(docs: DataFrame, field: Field) -> DataFrame:
    """docs (doc_id, text and others) with base and spans: arrays of (start, end, kind), in code points.

    Columns of docs by these names are replaced.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)  # a few hundred weights
    name = uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    at_text = f"c{kept.index('text')}"
    kind = "array<struct<start: int, end: int, kind: string>>"
    schema = T.StructType([*own.schema.fields, *T.StructType.fromDDL(f"base {kind}, spans {kind}").fields])
    target, given = common.to_arrow(schema), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(name, shared.value)
        for batch in batches:
            found = [own.spans(text) for text in batch.column(at_text).to_pylist()]
            lists = [[[dict(zip(("start", "end", "kind"), s)) for s in x] for x in side] for side in zip(*found)]
            if found:
                made = [pa.array(x, target.field(c).type) for x, c in zip(lists, ("base", "spans"))]
                same = [batch.column(i).cast(target.field(i).type) for i in range(given)]
                yield pa.RecordBatch.from_arrays([*same, *made], schema=target)

    return own.mapInArrow(run, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(kept)})


def merged_cuts(spans: str, mark: str):
    """The column text with every stretch that the sorted spans cover replaced by mark."""

    def step(done, span):
        # done: the text so far and the place up to which the original is used up
        new = F.substring("text", done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        fresh = span["start"] >= done["at"]
        return F.struct(
            F.when(fresh, F.concat(done["out"], new, F.lit(mark))).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], span["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        spans, start, step, lambda done: F.concat(done["out"], F.substring("text", done["at"] + 1, F.length("text")))
    )


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with the secrets in text replaced by mark; n_chars, where there is one, follows the text."""
    columns = docs.columns
    found = scanned(docs, fitted(docs))
    cut = F.size("spans") > 0
    changed = found.withColumn("text", F.when(cut, merged_cuts("spans", mark)).otherwise(F.col("text")))
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = changed.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*[F.col(f"`{c}`") for c in columns])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")

    def listed(column: str):
        return F.array_join(
            F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scanned(docs, fitted(docs)).select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(F.encode(listed("base"), "UTF-8"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
