"""Mixtures of sources at target shares of all tokens, in the order of a time-varying curriculum.

Every source of a mixture has a weight schedule over training time 0..1, a line from a start to an
end weight whose mean is the source's target share; at any time the weights sum to 1. Integrated,
the schedule says how many tokens of the source are demanded until then. The documents of a source,
in the order of a hash and repeated in turns, are laid end to end by their token counts; inverting
the demand at a document's middle gives its training time, and a range sort by time gives positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from scorelake.operators.prefix import running_total
from scorelake.storage import materialize


def _source(c: str) -> Column:
    return F.coalesce(F.lower(F.btrim(F.col(c), F.lit(" \t\r\n "))), F.lit(""))


def sized_documents(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Stored rows (doc_id, source, n_tokens); sources without case and surrounding blanks, '' for null."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _source("source").alias("source"), "text")
    return materialize(token_counts(slim, "text", ("doc_id", "source"), folder, vocabulary), "sizes")


def plan(sizes: DataFrame, targets: DataFrame, budget_tokens: int | None = None) -> list[dict]:
    """What each source of each mixture gives: one entry per row of ``targets`` (a small table of settings).

    Without a budget a mixture is as large as its sources allow: every source that has documents
    reaches its share with no document used more than max_repeats times. Sources without documents
    or without allowed repeats can't give anything; the others keep their proportions. With a budget,
    sources that run out give all they may, and the shares really reached tell.
    """
    wanted = targets.select("mix_id", _source("source").alias("source"), F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0))).alias("share"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    wanted = wanted.groupBy("mix_id", "source").agg(F.sum("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    totals = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = [r.asDict() for r in wanted.join(totals, "source", "left").orderBy("mix_id", "source").collect()]
    for mix in {r["mix_id"] for r in rows}:
        own = [r for r in rows if r["mix_id"] == mix]
        able = [r for r in own if r["tokens"] and r["max_repeats"] and r["share"]]
        share = sum(r["share"] for r in able) or 1.0
        total = budget_tokens if budget_tokens is not None else min((r["max_repeats"] * r["tokens"] * share / r["share"] for r in able), default=0)
        natural = sum(r["tokens"] for r in able) or 1
        for r in own:
            r |= {"aim": 0.0, "demand": 0.0, "start": 0.0, "end": 0.0}
        for r in able:
            r["aim"] = r["share"] / share
            r["demand"] = min(total * r["aim"], float(r["max_repeats"] * r["tokens"]))
        # From the sources' natural proportions, as far as no weight falls below 0, to what evens them out.
        gap = {r["source"]: r["tokens"] / natural - r["aim"] for r in able}
        lean = min([1.0, *(r["aim"] / g for r in able if (g := gap[r["source"]]) > 0)])
        for r in able:
            r["start"], r["end"] = r["aim"] + lean * gap[r["source"]], r["aim"] - lean * gap[r["source"]]
    return rows


_PLAN = "mix_id string, source string, share double, max_repeats int, tokens long, aim double, demand double, start double, end double"


def _plan_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in _PLAN.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], _PLAN)


def mix(sizes: DataFrame, planned: list[dict], seed: int = 11) -> DataFrame:
    """Rows (mix_id, position, doc_id, source, repeat_no, n_tokens, training_time), in the order of training.

    A copy of a document is in where its middle lies within the source's demand. Documents without
    tokens, of sources that no mixture names, or of null source are left out.
    """
    spark = sizes.sparkSession
    table = F.broadcast(_plan_table(spark, planned).where("demand > 0"))  # one row per row of the settings
    named = sizes.where("n_tokens > 0").join(table.select("source").distinct(), "source", "left_semi").withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    laid = running_total(named, ["source"], ["draw", "doc_id"], "n_tokens", "before")
    middle = F.col("before") + F.col("n_tokens") / 2
    copies = F.least(F.col("max_repeats"), F.floor((F.col("demand") - middle) / F.col("tokens")).cast("int") + 1)
    used = laid.join(table, "source").where(middle <= F.col("demand")).withColumn("repeat_no", F.explode(F.sequence(F.lit(1), copies)))
    # Demand until t, as a share of the source's whole demand: (start*t + (end-start)*t*t/2) / aim.
    part = ((F.col("repeat_no") - 1) * F.col("tokens") + middle) / F.col("demand") * F.col("aim")
    slope = F.col("end") - F.col("start")
    root = (F.sqrt(F.greatest(F.lit(0.0), F.col("start") * F.col("start") + 2 * slope * part)) - F.col("start")) / slope
    time = F.when(F.abs(slope) < 1e-12, part / F.col("aim")).otherwise(root)
    timed = used.select("mix_id", "doc_id", "source", "repeat_no", "n_tokens", F.least(F.lit(1.0), F.greatest(F.lit(0.0), time)).alias("training_time"))
    placed = running_total(timed, ["mix_id"], ["training_time", "source", "doc_id", "repeat_no"], None, "position")
    return placed.select("mix_id", "position", "doc_id", "source", "repeat_no", "n_tokens", "training_time")


def shares(mixed: DataFrame, planned: list[dict]) -> DataFrame:
    """Per mixture and source: target and actual share, tokens, documents, uses and most repeats; also of sources that give nothing."""
    given = mixed.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("uses"), F.max("repeat_no").alias("most_repeats"))
    whole = given.groupBy("mix_id").agg(F.sum("mixed_tokens").alias("all_tokens"))
    rows = _plan_table(mixed.sparkSession, planned).join(given, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    actual = F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0))
    return rows.select("mix_id", "source", F.col("share").alias("target_share"), actual.alias("actual_share"), zero("mixed_tokens"), zero("documents"), zero("uses"), zero("most_repeats"), "max_repeats", F.coalesce("tokens", F.lit(0)).alias("available_tokens"))
