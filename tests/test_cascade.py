"""The decision cascade's cache: what it keeps, and that a second run answers from it."""

from pyspark.sql import functions as F

from consentry.operators import decide
from consentry.plans.inputs import frame


def test_second_run_answers_from_the_cache(spark, sf, tmp_path):
    parts = [frame(spark, sf, p) for p in ("events", "docs", "statements", "prefs")]
    decide.decide(*parts, detailed=True).write.parquet(str(tmp_path / "first"))
    first = spark.read.parquet(str(tmp_path / "first"))
    cache = decide.to_cache(first)
    assert {r.system_used for r in cache.select("system_used").distinct().collect()} <= {"consent_guardrail", "rule_fallback"}
    assert cache.count() == cache.select("cache_key").distinct().count() > 0
    again = decide.decide(*parts, cache=cache, detailed=True)
    both = again.alias("b").join(first.alias("a"), "event_id")
    got = both.agg(F.count("*").alias("n"), F.count_if(F.col("a.decision") != F.col("b.decision")).alias("other"), F.count_if(F.col("b.from_cache")).alias("hits"), F.count_if((F.col("b.system_used") == "rule_fallback") & ~F.col("b.from_cache")).alias("scored"), F.count_if(F.col("b.from_cache") & F.col("a.system_used").isin("triage_layer", "no_policy", "consent_guardrail")).alias("wrong")).first()
    assert got.n == 1000 and got.other == got.scored == got.wrong == 0 < got.hits


def test_stored_steps_decide_the_same_and_cut_the_plan(spark, sf):
    """With tables in between the decisions are the same, and the last step reads the tables instead of moving the events again."""
    parts = [frame(spark, sf, p) for p in ("events", "docs", "statements", "prefs")]
    plain, stored = decide.decide(*parts), decide.decide(*parts, stored=True)
    assert any("events.parquet" in f for f in plain.inputFiles()) and not any("events.parquet" in f or "pages.parquet" in f for f in stored.inputFiles())
    assert plain.exceptAll(stored).count() == stored.exceptAll(plain).count() == 0 < stored.count()


def test_cache_keeps_the_last_and_skips_models_and_hits(spark):
    rows = [(1, "allow", 0.1, "rule_fallback", 3, "k", False), (2, "deny", 0.9, "fast_system", 1, "k", False), (3, "allow", 0.2, "fast_system", 1, "k", True)]
    rows += [(4, "deny", 0.8, "llm_agent", 2, "m", False), (5, "allow", 0.0, "triage_layer", 0, "t", False), (6, "deny", 1.0, "no_policy", 0, "n", False)]
    got = decide.to_cache(spark.createDataFrame(rows, "event_id long, decision string, risk_score double, system_used string, n_evidence long, cache_key string, from_cache boolean"))
    assert [tuple(r) for r in got.collect()] == [("k", "deny", 0.9, "fast_system", 1)]


def test_key_depends_on_preferences_not_on_order(spark):
    rows = [(["b", "a"], "x", {"consent.ads": "opt-in"}), (["a", "b"], "x", {"consent.ads": "opt-in"}), (["a", "b"], "x", {"consent.ads": "opt-out"}), (["a", "b"], None, None)]
    e = spark.createDataFrame(rows, "data_categories array<string>, domain string, prefs map<string,string>")
    e = e.withColumns({"actions": F.array().cast("array<string>"), "purposes": F.lit(None).cast("array<string>"), "recipients": F.array(F.lit("r")), "action_type": F.lit("fetch")})
    a, b, c, d = (r[0] for r in e.select(decide.cache_key()).collect())
    assert a == b and len({a, c, d}) == 3 and all(len(k) == 32 for k in (a, c, d))
