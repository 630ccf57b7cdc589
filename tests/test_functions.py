"""Edge cases of the risk and text functions, one row each."""

import pytest
from pyspark.sql import functions as F

from consentry.functions import risk as R
from consentry.functions import text as X
from consentry.operators import anonymize, metrics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def strings(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


@pytest.mark.parametrize("purposes, want", [((), 0.65), (("Legal",), 0.5), (("Profiling",), 0.75), (("",), 0.15)])
def test_purpose(spark, purposes, want):
    assert one(spark, R.purpose(strings(*purposes))) == want


@pytest.mark.parametrize("recipients, actions, want", [((), ("Use",), 0.5), (("third_party_analytics",), (), 0.5), (("acme",), (), 0.7), ((), ("Sell",), 0.75)])
def test_transmission(spark, recipients, actions, want):
    assert one(spark, R.transmission(strings(*recipients), strings(*actions))) == want


@pytest.mark.parametrize("risk, categories, want", [(0.35, ("cookies",), "transform"), (0.20, ("Health",), "transform"), (0.1999, ("Health",), "allow"), (0.70, (), "deny")])
def test_decision(spark, risk, categories, want):
    assert one(spark, R.decision(F.lit(risk), R.decision_tier(strings(*categories)))) == want


def test_low_tier_only_in_bands(spark):
    assert one(spark, R.band_tier(strings("cookies"))) == "low"
    assert one(spark, R.decision_tier(strings("cookies"))) == "moderate"


@pytest.mark.parametrize("risk, want", [(0.49, 1), (0.5, 2), (0.7, 3), (0.85, 4)])
def test_level(spark, risk, want):
    assert one(spark, R.level(F.lit(risk))) == want


@pytest.mark.parametrize("risk, tier, want", [(0.40, "high", 2), (0.65, "high", 4), (0.1, "low", 1)])
def test_banded(spark, risk, tier, want):
    assert one(spark, R.banded_level(F.lit(risk), F.lit(tier))) == want


def test_nulls_are_empty(spark):
    null = F.lit(None).cast("array<string>")
    assert one(spark, R.severity(null, null, null, null, F.lit(None).cast("string"))) == pytest.approx(0.1 * (0.6 + 0.9 * 0.5) * (0.5 + 0.9 * 0.65))
    assert one(spark, X.jaccard(strings(), strings())) == 1.0


@pytest.mark.parametrize(
    "level, text, want",
    [
        (3, "Credit card 4532 1234 5678 9012 expiry 03/27 CVV 456", "Credit card [CREDIT_CARD] CVV 456"),
        (3, "call +61 400 123 456 now", "call +[PHONE]now"),
        (1, "mail jane@example.com", "mail j***@example.com"),
        (2, "mail jane@example.com", "mail ***@example.com"),
        (3, "[CREDIT_CARD] [CREDIT_CARD]", "[CREDIT_CARD] [CREDIT_CARD]"),
    ],
)
def test_rewrite(spark, level, text, want):
    assert one(spark, X.rewrite(F.lit(text), X.entities(F.lit(text)), level)) == want


@pytest.mark.parametrize("guess, text, want", [("  ", "any", True), ("the x", "the y", True), ("Bob", "Alice here", False)])
def test_verifier(spark, guess, text, want):
    assert one(spark, X.lexical_verified(F.lit(guess), F.lit(text))) is want


def test_adaptive_stops_at_the_first_safe_level(spark):
    d = spark.createDataFrame([("mail jane@example.com",)], "text string")
    r = anonymize.adaptive(d, F.lit(1), lambda t: F.contains(t, F.lit("j***"))).first()
    assert (r.final_level, r.anonymized, r.rounds, r.upgraded) == (2, "mail ***@example.com", 2, True)


def test_holm_and_wilson(spark):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double")
    assert {r.k: r.significant for r in metrics.holm(t, "p", "k").collect()} == {1: True, 2: False, 3: False}
    lo, hi = metrics.wilson(F.lit(0), F.lit(0))
    assert (one(spark, lo), one(spark, hi)) == (0.0, 0.0)


def test_decisions_of_streams_are_those_of_batches(spark, sf, tmp_path):
    from consentry.operators import decide
    from consentry.plans.inputs import frame
    from consentry.streaming import decisions

    events, docs, statements, prefs = (frame(spark, sf, p) for p in ("events", "docs", "statements", "prefs"))
    events.limit(200).write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    got = []
    q = decisions.decide_stream(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), docs, statements, prefs, lambda d, _: got.extend(map(tuple, d.collect())), f"{tmp_path}/at")
    q.awaitTermination()
    assert sorted(got) == sorted(map(tuple, decide.decide(batch, docs, statements, prefs).collect()))
