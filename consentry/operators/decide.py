"""The decision cascade: triage, consent guard, policy retrieval, risk, decision - in one declarative plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions import tables as T
from ..functions import text as X
from ..sources import shared
from . import retrieval

#: Characters of a statement's text from which it counts as long.
LONG_SNIPPET = 50


def is_capture() -> Column:
    return F.lower(F.coalesce("action_type", F.lit(""))).isin(*T.CAPTURE_ACTIONS)


def enriched() -> Column:
    """Data categories, with those told by the masked text of a captured field added (sorted, without repeats)."""
    found = X.found_terms(F.col("masked"), T.FIELD_PATTERNS)
    own = F.coalesce("data_categories", F.array().cast("array<string>"))
    return F.when(is_capture() & (F.size(found) > 0), F.array_sort(F.array_distinct(F.concat(own, found)))).otherwise(own)


def skipped() -> Column:
    """Whether triage lets the event pass: not captured, and its first category is an ignored kind of resource."""
    first = F.lower(F.coalesce(F.get("data_categories", F.lit(0)), F.lit("")))
    return ~is_capture() & first.isin(*T.IGNORED_RESOURCES)


def ads_blocked() -> Column:
    """Whether the user opted out of ads and a purpose contains "ads"."""
    out = F.lower(F.trim(F.coalesce("ads_consent", F.lit("")))) == "opt-out"
    return out & F.exists(F.coalesce("purposes", F.array().cast("array<string>")), lambda p: F.contains(F.lower(p), F.lit("ads")))


def latest_preferences(prefs: DataFrame) -> DataFrame:
    """(user_id, prefs map): per user the last value of each namespace and key, by update time and then id."""
    last = prefs.groupBy("user_id", "namespace", "key").agg(F.max_by("value", F.struct("updated_at", "id")).alias("value"))
    return last.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(".", "namespace", "key").alias("key"), "value")))).alias("prefs"))


def evidence_signals(top: DataFrame) -> DataFrame:
    """Per event what its evidence shows (see R.transparency)."""
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    meets = lambda f: F.size(F.array_intersect(F.coalesce(f"s_{f}", F.array().cast("array<string>")), F.coalesce(f, F.array().cast("array<string>")))) > 0
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return top.groupBy("event_id").agg(
        F.count("*").alias("n_evidence"), any_(F.length("s_snippet") >= LONG_SNIPPET).alias("long_snippet"), any_(meets("data_categories")).alias("same_category"), any_(meets("purposes")).alias("same_purpose"),
        any_(has("s_legal_basis")).alias("legal"), any_(F.col("s_rights_flag")).alias("rights"), any_(has("s_retention_mode")).alias("retention"),
        F.min_by(F.struct("score", "s_id", *[f"s_{f}" for f in retrieval.FIELDS]), "rank").alias("top"),
    )


def cache_key() -> Column:
    """Key of a raw behaviour, its domain and the user's preferences: 32 hex digits of a SHA-256 of canonical JSON."""
    texts = F.transform(F.map_entries("prefs"), lambda p: F.concat_ws("=", p["key"], p["value"]))
    own = {c: X.json_list(F.coalesce(c, F.array().cast("array<string>"))) for c in retrieval.FIELDS}
    own |= {c: X.json_text(F.col(c)) for c in ("domain", "action_type")} | {"user_prefs": X.json_list(texts)}
    return F.left(F.sha2(X.canonical_json(own), 256), F.lit(32))


def to_cache(detailed: DataFrame) -> DataFrame:
    """What a cache keeps of detailed decisions: per key the last one, but none of triage, of a model asked, without a policy or from the cache itself."""
    new = detailed.where(~F.col("from_cache") & F.col("system_used").isin("consent_guardrail", "fast_system", "rule_fallback"))
    kept = ("decision", "risk_score", "system_used", "n_evidence")
    return new.groupBy("cache_key").agg(F.max_by(F.struct(*kept), "event_id").alias("last")).select("cache_key", *[f"last.{c}" for c in kept])


def decide(
    events: DataFrame,
    docs: DataFrame,
    statements: DataFrame,
    prefs: DataFrame | None = None,
    likelihood: Column | None = None,
    top_k: int = 8,
    alpha: float = 0.6,
    cache: DataFrame | None = None,
    fast: Callable[[], tuple[Column, Column]] | None = None,
    model: Callable[[DataFrame], DataFrame] | None = None,
    sure: float = 0.25,
    detailed: bool = False,
    stored: bool = False,
) -> DataFrame:
    """One row per event: decision, risk_score (12 digits), system_used and n_evidence; detailed adds cache_key, from_cache and uncertainty.

    events: event_id, user_id, domain, action_type, platform, app_id, masked and
    the arrays data_categories, actions, purposes, recipients. prefs: user_id,
    namespace, key, value, updated_at, id. likelihood: of harm where a policy
    is found, 0.5 by default; without a policy it is 1. cache: rows as of to_cache;
    events whose key it has are neither retrieved for nor scored. fast: likelihood
    and uncertainty from the event's columns and the struct top, its best
    statement; it decides where the uncertainty is below sure. model: gets the rows with a
    column needs_model and adds llm_score, a likelihood, to those where that holds. stored: guarded events, keyword scores and
    evidence are written to tables in between, so that events are moved once for each and shuffles do not add up (for large batches).
    """
    e = events.withColumns({"skip": skipped(), "user_id": F.coalesce(F.col("user_id").cast("string"), F.lit("user:local"))})
    if prefs is not None:
        e = e.join(latest_preferences(prefs).withColumn("user_id", F.col("user_id").cast("string")), "user_id", "left")
        e = e.withColumn("ads_consent", F.try_element_at("prefs", F.lit("consent.ads")))
    else:
        e = e.withColumns({"prefs": F.lit(None).cast("map<string,string>"), "ads_consent": F.lit(None).cast("string")})
    e = e.withColumn("blocked", ads_blocked())
    if cache is not None or detailed:
        e = e.withColumn("cache_key", cache_key())
    if cache is not None:
        known = cache.select("cache_key", F.struct("decision", "risk_score", "system_used", "n_evidence").alias("cached"))
        e = e.join(known, "cache_key", "left").withColumn("from_cache", F.col("cached").isNotNull() & ~F.col("skip") & ~F.col("blocked"))
    else:
        e = e.withColumns({"from_cache": F.lit(False), "cached": F.lit(None).cast("struct<decision:string,risk_score:double,system_used:string,n_evidence:long>")})
    e = e.withColumn("data_categories", enriched())  # the key is of the categories as they came
    if stored:
        e = shared.written(e, "guarded")
    met = retrieval.matched(e.where("not skip and not blocked and not from_cache"), docs)
    found = evidence_signals(retrieval.hybrid(met, statements, alpha, top_k, LONG_SNIPPET, stored))
    if stored:
        found = shared.written(found, "evidence")
    x = e.join(found, "event_id", "left")
    lone = F.col("n_evidence").isNull()
    x = x.withColumns(dict(zip(("_fast", "uncertainty"), fast() if fast else (F.lit(None).cast("double"), F.lit(1.0)), strict=True)))
    quick = ~lone & (F.col("uncertainty") < sure)
    if model is not None:
        x = model(x.withColumn("needs_model", ~lone & ~F.coalesce(quick, F.lit(False))))
        asked = F.col("needs_model") & F.col("llm_score").isNotNull()
    else:
        x, asked = x.withColumn("llm_score", F.lit(None).cast("double")), F.lit(False)
    s = R.severity(*(F.col(c) for c in ("data_categories", "actions", "purposes", "recipients", "action_type")))
    t = R.transparency(*(F.col(c) for c in ("n_evidence", "long_snippet", "same_category", "same_purpose", "legal", "rights", "retention")))
    l = F.when(lone, 1.0).when(quick, F.col("_fast")).when(asked, F.col("llm_score")).otherwise(likelihood if likelihood is not None else F.lit(0.5))
    x = x.withColumns({"_risk": F.round(R.risk(l, s, t), 12), "_tier": R.decision_tier(F.col("data_categories"))})
    r, cached = F.col("_risk"), F.col("from_cache")
    out = [
        F.when(F.col("skip"), "allow").when(F.col("blocked"), "deny").when(cached, F.col("cached.decision")).otherwise(R.decision(r, F.col("_tier"))).alias("decision"),
        F.when(F.col("skip"), 0.0).when(F.col("blocked"), 1.0).when(cached, F.col("cached.risk_score")).otherwise(r).alias("risk_score"),
        F.when(F.col("skip"), "triage_layer").when(F.col("blocked"), "consent_guardrail").when(cached, F.col("cached.system_used")).when(lone, "no_policy").when(quick, "fast_system").when(asked, "llm_agent").otherwise("rule_fallback").alias("system_used"),
        F.when(cached, F.col("cached.n_evidence")).when(quick, 1).otherwise(F.coalesce("n_evidence", F.lit(0))).cast("long").alias("n_evidence"),
    ]
    more = [F.col("cache_key"), cached, F.col("uncertainty")] if detailed else []
    return x.select("event_id", *out, *more)
