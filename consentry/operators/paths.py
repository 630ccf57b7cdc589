"""Anonymiser configurations run over samples, and their results summed up by mergeable sketches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions import text as X
from . import anonymize, guessing

RESULT = ("anonymized", "level", "initial_level", "rounds", "upgraded")
#: A configuration: samples (with text, risk_score and sensitive_fields) to the same rows with RESULT's columns.
Configuration = Callable[[DataFrame], DataFrame]


def masked_only(cap: int = 3, named: str | None = None) -> Configuration:
    """Patterns and names masked at the level of the risk, no model."""

    def run(samples: DataFrame) -> DataFrame:
        x = anonymize.masked(samples.withColumn("level", F.least(R.level(F.col("risk_score")), F.lit(cap)).cast("int")), F.col("level"), named=named)
        return x.select(*samples.columns, "anonymized", "level", F.col("level").alias("initial_level"), F.lit(1).alias("rounds"), F.lit(False).alias("upgraded"))

    return run


def guessed(guesser, log: str, cap: int = 3, max_rounds: int = 3, rewriter=None, rewrite_from: int = 4, named: str | None = None, **options) -> Configuration:
    """Masked (or rewritten) texts that go up a level while the guesser identifies what was taken out."""

    def run(samples: DataFrame) -> DataFrame:
        x = guessing.loop(samples, R.level(F.col("risk_score")), guesser, log, cap=cap, max_rounds=max_rounds, rewriter=rewriter, rewrite_from=rewrite_from, named=named, **options)
        return x.select(*samples.columns, "anonymized", F.col("final_level").alias("level"), "initial_level", "rounds", "upgraded")

    return run


def rewritten(rewriter, log: str, **options) -> Configuration:
    """A model's rewrite at the level of the risk, not checked by a guesser."""
    return guessed(None, log, cap=5, max_rounds=1, rewriter=rewriter, rewrite_from=1, **options)


def results(samples: DataFrame, configurations: dict[str, Configuration], failed: Callable[[str], Column] | None = None) -> DataFrame:
    """One row per configuration and sample: config, RESULT's columns, error, utility (shared tokens), privacy (1 - share of sensitive fields kept).

    A result without a text, or one of which failed(config) says why it failed, is the original at level 0, with the error.
    samples: sample_id, text, risk_score, sensitive_fields and any others.
    """
    out = None
    for name, run in configurations.items():
        x = run(samples).withColumn("error", F.coalesce(failed(name) if failed else F.lit(None).cast("string"), F.when(F.col("anonymized").isNull(), "NoText")))
        bad = F.col("error").isNotNull()
        x = x.withColumns({"anonymized": F.when(bad, F.coalesce("text", F.lit(""))).otherwise(F.col("anonymized")), "upgraded": ~bad & F.col("upgraded")} | {c: F.when(bad, 0).otherwise(F.col(c)).cast("int") for c in ("level", "initial_level", "rounds")})
        x = x.withColumns({"config": F.lit(name), "utility": X.jaccard(X.tokens(F.col("text")), X.tokens(F.col("anonymized"))), "privacy": 1.0 - X.retained(F.col("anonymized"), F.col("sensitive_fields"))})
        out = x if out is None else out.unionByName(x)
    return out


MEASURES = ("utility", "privacy", "level")


def partial(rows: DataFrame, *by: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Per config (and by) counts, sums and a quantile sketch of each measure: rows of a table that runs append to."""
    out = [F.count("*").alias("n"), F.count("error").alias("errors"), F.count_if("upgraded").alias("upgraded")]
    for m in measures:
        out += [F.sum(F.col(m).cast("double")).alias(f"{m}_sum"), F.kll_sketch_agg_double(F.col(m).cast("double")).alias(f"{m}_sketch")]
    return rows.groupBy("config", *by).agg(*out)


def summary(partials: DataFrame, measures: tuple[str, ...] = MEASURES, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Of partial()'s rows, of any number of runs: per config n, errors, upgraded, and mean and quantiles of each measure."""
    merged = partials.groupBy("config").agg(*(F.sum(c).alias(c) for c in ("n", "errors", "upgraded", *(f"{m}_sum" for m in measures))), *(F.kll_merge_agg_double(f"{m}_sketch").alias(f"{m}_sketch") for m in measures))
    out = []
    for m in measures:
        out.append((F.col(f"{m}_sum") / F.col("n")).alias(f"avg_{m}"))
        out += [F.kll_sketch_get_quantile_double(F.col(f"{m}_sketch"), F.lit(q)).alias(f"{m}_p{round(100 * q)}") for q in quantiles]
    return merged.select("config", "n", "errors", "upgraded", *out)


def benchmark(samples: DataFrame, configurations: dict[str, Configuration], table: str, run: str, failed: Callable[[str], Column] | None = None) -> DataFrame:
    """Runs the configurations, appends their partial sums to the table under the run's name, and gives the summary of all runs in it."""
    # summed as they are computed: results are as large as the texts and read once
    partial(results(samples, configurations, failed)).withColumn("run", F.lit(run)).write.mode("append").parquet(table)
    return summary(samples.sparkSession.read.parquet(table))
