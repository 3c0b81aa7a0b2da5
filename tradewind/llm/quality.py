"""Quality rules with thresholds that follow each language and source instead of fixed cutoffs.

One pass over the whole texts counts words, symbols, lines and repeated windows. The ratios drawn
from the counts go into quantile sketches per (language, source): a sketch is the count of values in
logarithmic buckets (relative error GAMMA, after Masson, Rim and Lee, "DDSketch"), so sketches merge
by adding counts, in any order, with the same result each time. Merging the sketches of a language,
or of everything, gives the thresholds for groups with too few rows. The thresholds are joined back
to the documents, which are then kept or rejected.

Nulls: a null text has no words; null languages and sources are groups of their own. A document
whose id is null stays with its result. Rows that repeat an id are judged each by their own text. Texts of any length are counted
whole, a text at a time. An empty table gives an empty result; extra columns are ignored, also those named like a measure.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm import common
from tradewind.sources import scratch

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Growth of a sketch's buckets: quantiles are off by less than half of it.
GAMMA = 1.02
#: Groups with fewer rows take the thresholds of their language, or of all documents.
MIN_GROUP = 200

#: Half spreads away from the median at which a fence stands.
FENCE = 6.0
#: Measure: (how it is drawn from the counts, least half spread, whether low values are rejected too).
MEASURES = {
    "symbols": ("n_symbols / word_chars", 0.01, False),
    "stutter": ("n_stutter / n_words", 0.03, False),
    "same_lines": ("n_dup_lines / n_lines", 0.08, False),
    "word_length": ("word_chars / n_words", 0.25, True),
}

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
#: What tells a row of a table from others; equal rows have equal verdicts.
ROW = ("doc_id", "lang", "source", "text_hash")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter")


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    text = text or ""
    raw = text.encode()
    found = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.uint64, len(found))
    repeated = 0
    if len(found) > WINDOW:
        grams = common.rolled((ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), WINDOW)
        order = np.argsort(grams)
        same = grams[order[1:]] == grams[order[:-1]]
        if same.any():
            twice = np.zeros(len(grams), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(found), bool)
            for i in range(WINDOW):
                covered[i : i + len(grams)] |= twice
            repeated = int(covered.sum())
    return (
        len(found),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int((ids[1:] == ids[:-1]).sum()),
    )


def _stat_rows(batch: dict) -> dict:
    stats = list(zip(*map(text_stats, batch["text"])))
    return {**{k: batch[k] for k in ROW}, **dict(zip(STATS, stats))}


def document_stats(docs: DataFrame) -> DataFrame:
    """ROW and STATS of every document."""
    narrow = common.renamed_clear(docs, ("doc_id", "lang", "source", "text")).withColumn("text_hash", F.xxhash64("text"))
    kinds = dict(narrow.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ROW] + [f"{c} bigint" for c in STATS])
    return common.arrow_map(narrow, _stat_rows, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )


def measured(stats: DataFrame) -> DataFrame:
    """stats with the MEASURES (null where there are no words)."""
    some = F.col("n_words") > 0
    return stats.withColumns({m: F.when(some, F.expr(how)) for m, (how, _, _) in MEASURES.items()})


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: one mergeable quantile sketch per language, source and measure."""
    names = ", ".join(f"'{m}', `{m}`" for m in MEASURES)
    values = measured(stats).filter("n_words > 0").selectExpr(
        "lang", "source", f"stack({len(MEASURES)}, {names}) as (measure, value)"
    )
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / math.log(GAMMA)))
    return values.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up per keys, and their quartiles."""
    own = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = ", ".join([*keys, "measure"])
    ranked = own.selectExpr(
        *keys,
        "measure",
        f"if(bucket is null, 0D, 2 * pow({GAMMA}D, bucket) / ({GAMMA}D + 1)) as value",
        f"sum(n) over (partition by {group} order by bucket nulls first) as upto",
        f"sum(n) over (partition by {group}) as total",
    )
    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        *[F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value"))).alias(f"q{q}") for q in (0.25, 0.5, 0.75)],
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and low_<measure>, high_<measure> for every measure."""
    own = merged(sketch, ["lang", "source"])
    by_lang = merged(sketch, ["lang"])
    overall = merged(sketch, [])
    quartiles = ("total", "q0.25", "q0.5", "q0.75")
    for level, name in ((by_lang, "l"), (overall, "a")):
        renamed = level.select(
            *[F.col(c).alias(f"{name}_{c}") for c in level.columns if c in ("lang", "measure")],
            *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in quartiles],
        )
        on = F.col("measure") == F.col(f"{name}_measure")
        if name == "l":
            on &= F.col("lang").eqNullSafe(F.col("l_lang"))
        own = own.join(renamed, on, "left")

    def pick(q: str):
        return F.when(F.col("total") >= MIN_GROUP, F.col(f"`{q}`")).when(
            F.col("l_total") >= MIN_GROUP, F.col(f"`l_{q}`")
        ).otherwise(F.col(f"`a_{q}`"))

    out = []
    for m, (_, spread, low) in MEASURES.items():
        mine = F.col("measure") == m
        mid = pick("q0.5")
        high = mid + FENCE * F.greatest(mid - pick("q0.25"), F.lit(spread))
        least = mid - FENCE * F.greatest(pick("q0.75") - mid, F.lit(spread)) if low else F.lit(0.0)
        out += [F.max(F.when(mine, high)).alias(f"high_{m}"), F.max(F.when(mine, least)).alias(f"low_{m}")]
    return own.groupBy("lang", "source").agg(*out)


def judged(docs: DataFrame) -> DataFrame:
    """ROW, STATS, base_failed and kept, one row per document."""
    stats = scratch.written(document_stats(docs), "quality-stats")
    limits = thresholds(sketches(stats)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = measured(stats).join(
        limits,
        F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")),
        "left",
    )
    fits = F.lit(True)
    for m in MEASURES:
        fits &= F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    return joined.withColumn("base_failed", base_failed()).select(
        *ROW, *STATS, "base_failed",
        (~F.col("base_failed") & F.coalesce(fits, F.lit(False))).alias("kept"),
    )


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, with their own columns.

    Verdicts are joined by id, language, source and a hash of the text, so rows that share an id are judged each.
    """
    kept = judged(docs).filter("kept").select(*[F.col(c).alias(f"__{c}") for c in ROW]).distinct()
    same = F.xxhash64("text") == F.col("__text_hash")
    for c in ("doc_id", "lang", "source"):
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return docs.join(kept, same, "left_semi")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
