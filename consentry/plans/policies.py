"""Queries of retrieval, risk and decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import risk as R
from ..functions import tables as T
from ..functions import text as X
from ..operators import decide, features, models, retrieval
from ..sources import readers
from . import twin
from .inputs import ctes, frame, unrolled

BEHAVIOUR = ("data_categories", "actions", "purposes", "recipients", "action_type")


def _cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _severity(**options) -> Column:
    return R.severity(*_cols(*BEHAVIOUR), **options)


EV = ctes("events")


@query("rk01_transmission", f"{EV} SELECT event_id, ({twin.TRANSMISSION})::DOUBLE AS transmission FROM events_in")
def rk01(spark, sf):
    return frame(spark, sf, "events").select("event_id", R.transmission(*_cols("recipients", "actions")).alias("transmission"))


@query("rk02_purpose", f"{EV} SELECT event_id, ({twin.PURPOSE})::DOUBLE AS purpose FROM events_in")
def rk02(spark, sf):
    return frame(spark, sf, "events").select("event_id", R.purpose(F.col("purposes")).alias("purpose"))


@query("rk03_severity", f"{EV} SELECT event_id, round({twin.severity()}, 12) AS severity FROM events_in")
def rk03(spark, sf):
    return frame(spark, sf, "events").select("event_id", F.round(_severity(), 12).alias("severity"))


_RISKS = f"{ctes('events')}, s AS (SELECT *, {twin.severity()} AS sev, {twin.TIER} AS tier, (event_id % 10)::DOUBLE / 10.0::DOUBLE AS l FROM events_in), r AS (SELECT *, round(least(1.0::DOUBLE, l * sev * 1.3::DOUBLE), 12) AS risk FROM s)"


def _risks(spark, sf):
    e = frame(spark, sf, "events").withColumns({"sev": _severity(), "tier": R.decision_tier(F.col("data_categories")), "l": F.col("event_id") % 10 / F.lit(10.0)})
    return e.withColumn("risk", F.round(R.risk(F.col("l"), F.col("sev"), F.lit(1.3)), 12))


@query("rk05_risk", f"{_RISKS} SELECT event_id, risk FROM r")
def rk05(spark, sf):
    return _risks(spark, sf).select("event_id", "risk")


@query("rk06_decision", f"{_RISKS} SELECT event_id, tier, {twin.DECISION} AS decision FROM r")
def rk06(spark, sf):
    return _risks(spark, sf).select("event_id", "tier", R.decision(*_cols("risk", "tier")).alias("decision"))


_Z = f"((risk - {twin.ALLOW}) / ({twin.DENY} - {twin.ALLOW}))"


@query("rk07_levels", f"{_RISKS} SELECT event_id, CASE WHEN risk < 0.5 THEN 1 WHEN risk < 0.7 THEN 2 WHEN risk < 0.85 THEN 3 ELSE 4 END AS level, CASE WHEN risk < {twin.ALLOW} THEN 1 WHEN risk >= {twin.DENY} THEN 4 WHEN {_Z} < 0.25 THEN 1 WHEN {_Z} < 0.5 THEN 2 WHEN {_Z} < 0.75 THEN 3 ELSE 4 END AS banded FROM r")
def rk07(spark, sf):
    return _risks(spark, sf).select("event_id", R.level(F.col("risk")).alias("level"), R.banded_level(*_cols("risk", "tier")).alias("banded"))


@query("rk08_ablations", f"{EV} SELECT event_id, round({twin.severity(basis='1.0')}, 12) AS no_basis, round({twin.severity(purpose='1.0::DOUBLE')}, 12) AS no_purpose FROM events_in")
def rk08(spark, sf):
    return frame(spark, sf, "events").select("event_id", F.round(_severity(use_basis=False), 12).alias("no_basis"), F.round(_severity(use_purpose=False), 12).alias("no_purpose"))


_B = "(CASE WHEN {0} < 0.2 THEN 1 WHEN {0} < 0.4 THEN 2 WHEN {0} < 0.6 THEN 3 WHEN {0} < 0.8 THEN 4 ELSE 5 END)"


@query(
    "rk09_rk12_other_models",
    f"""{_RISKS} SELECT event_id, {_B.format('l')} * {_B.format('sev')} / 25.0::DOUBLE AS nist,
    round(0.4::DOUBLE * l + 0.3::DOUBLE * (CASE WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 200 < 50 THEN 0.8 WHEN event_id % 200 < 150 THEN 0.5 ELSE 0.2 END)::DOUBLE + 0.3::DOUBLE * sev, 12) AS iso,
    round(least(1.0, l * (CASE WHEN list_has_any(actions, ['Share', 'Transfer']) THEN 1.3 ELSE 1.0 END)::DOUBLE) * least(1.0, sev * (CASE WHEN list_has_any(purposes, ['Advertising', 'Marketing', 'Unknown']) THEN 1.2 ELSE 1.0 END)::DOUBLE), 12) AS fair,
    round(least(1.0, l * sev * (1 + 0.5::DOUBLE * 0.3::DOUBLE)), 12) AS legacy FROM r""",
)
def rk09(spark, sf):
    e = _risks(spark, sf)
    return e.select("event_id", R.nist_5x5(*_cols("l", "sev")).alias("nist"), F.round(R.iso(F.col("l"), F.col("sev"), F.col("event_id") % 3 != 0, F.col("event_id") % 200), 12).alias("iso"), F.round(R.fair(*_cols("l", "sev", "actions", "purposes")), 12).alias("fair"), F.round(R.legacy(F.col("l"), F.col("sev"), F.lit(0.3), 0.5), 12).alias("legacy"))


_GRID = [(k, f) for k in ("allow", "deny") for f in (-0.05, 0.0, 0.05)]


@query(
    "rk14_sensitivity_grid",
    f"{_RISKS}, g AS (SELECT unnest([" + ", ".join(f"{{'threshold': '{k}', 'shift': {f}::DOUBLE}}" for k, f in _GRID) + f"""], recursive := true)),
    d AS (SELECT threshold, shift, CASE WHEN risk < greatest(0.0, least(1.0, {twin.ALLOW} + CASE WHEN threshold = 'allow' THEN shift ELSE 0 END)) THEN 'allow' WHEN risk < greatest(0.0, least(1.0, {twin.DENY} + CASE WHEN threshold = 'deny' THEN shift ELSE 0 END)) THEN 'transform' ELSE 'deny' END AS decision FROM r CROSS JOIN g)
    SELECT threshold, shift, decision, count(*) AS n FROM d GROUP BY ALL""",
)
def rk14(spark, sf):
    """Decisions counted under shifted thresholds, all shifts in one pass."""
    e = _risks(spark, sf).select("risk", "tier", F.explode(F.array(*[F.struct(F.lit(k).alias("threshold"), F.lit(f).alias("shift")) for k, f in _GRID])).alias("g")).select("risk", "tier", "g.*")
    bound = lambda k, name: F.greatest(F.lit(0.0), F.least(F.lit(1.0), R._threshold(F.col("tier"), k) + F.when(F.col("threshold") == name, F.col("shift")).otherwise(0.0)))
    d = F.when(F.col("risk") < bound(0, "allow"), "allow").when(F.col("risk") < bound(1, "deny"), "transform").otherwise("deny")
    return e.groupBy("threshold", "shift", d.alias("decision")).agg(F.count("*").alias("n"))


_BASE = "(CASE event_id % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.7 END)"


@query("rk15_corpus_truth", f"WITH t AS (SELECT event_id, round(least(1.0, {_BASE}::DOUBLE * (1 + 0.15::DOUBLE * (5 - (1 + event_id % 5)))), 6) AS risk FROM events) SELECT *, CASE WHEN risk < 0.3 THEN 'allow' WHEN risk < 0.7 THEN 'transform' ELSE 'deny' END AS decision FROM t")
def rk15(spark, sf):
    r, _ = R.corpus_truth(F.expr(_BASE).cast("double"), 1 + F.col("event_id") % 5)
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(r, 6).alias("risk"))
    return e.select("event_id", "risk", F.when(F.col("risk") < 0.3, "allow").when(F.col("risk") < 0.7, "transform").otherwise("deny").alias("decision"))


_GUARD = f"guard AS (SELECT e.* EXCLUDE (data_categories), {twin.ENRICHED} AS data_categories, {twin.SKIP} AS skip, (lower(trim(p.value)) = 'opt-out' AND len(list_filter(purposes, lambda x: contains(lower(x), 'ads'))) > 0) IS TRUE AS blocked FROM events_in e LEFT JOIN (SELECT user_id, max_by(value, updated_at) AS value FROM prefs_in GROUP BY 1) p USING (user_id))"


@query(
    "rk18_decide_events",
    f"""{ctes('events', 'docs', 'statements', 'prefs')}, {_GUARD}, {twin.LATEST}, {twin.CANDIDATES.format('(SELECT * FROM guard WHERE NOT skip AND NOT blocked)')}, {twin.BM25}, {twin.KEYWORD}, {twin.HYBRID}, {twin.EVIDENCE},
    f AS (SELECT g.*, {twin.TIER} AS tier, n_evidence, round(least(1.0::DOUBLE, (CASE WHEN n_evidence IS NULL THEN 1.0 ELSE 0.5 END)::DOUBLE * {twin.severity()} * {twin.TRANSPARENCY}), 12)::DOUBLE AS risk FROM guard g LEFT JOIN evd USING (event_id))
    SELECT event_id, CASE WHEN skip THEN 'allow' WHEN blocked THEN 'deny' ELSE {twin.DECISION} END AS decision, CASE WHEN skip THEN 0.0 WHEN blocked THEN 1.0 ELSE risk END AS risk_score,
      CASE WHEN skip THEN 'triage_layer' WHEN blocked THEN 'consent_guardrail' WHEN n_evidence IS NULL THEN 'no_policy' ELSE 'rule_fallback' END AS system_used, coalesce(n_evidence, 0) AS n_evidence FROM f""",
)
def rk18(spark, sf):
    return decide.decide(*(frame(spark, sf, p) for p in ("events", "docs", "statements", "prefs")), stored=True)


_SORTED = "'[' || array_to_string(list_transform(list_sort({}), lambda x: '\"' || x || '\"'), ', ') || ']'"
_TEXT = "coalesce('\"' || {} || '\"', 'null')"
_JSON = (
    "left(sha256('{\"action_type\": ' || " + _TEXT.format("action_type") + " || ', \"actions\": ' || " + _SORTED.format("actions") + " || ', \"data_categories\": ' || " + _SORTED.format("data_categories") + " || ', \"domain\": ' || " + _TEXT.format("domain")
    + " || ', \"purposes\": ' || " + _SORTED.format("purposes") + " || ', \"recipients\": ' || " + _SORTED.format("recipients") + " || ', \"user_prefs\": ' || coalesce('[\"consent.ads=' || p.value || '\"]', 'null') || '}'), 32)"
)
_LAST = "lastp AS (SELECT user_id, max_by(value, updated_at) AS value FROM prefs_in GROUP BY 1)"


@query("rk17_cache_keys", f"{ctes('events', 'prefs')}, {_LAST} SELECT {_JSON} AS cache_key, count(*) AS hits, min(event_id) AS first_event FROM events_in LEFT JOIN lastp p USING (user_id) GROUP BY ALL")
def rk17(spark, sf):
    """The cascade's own cache keys: how many events share each."""
    e = frame(spark, sf, "events").join(decide.latest_preferences(frame(spark, sf, "prefs")), "user_id", "left")
    return e.groupBy(decide.cache_key().alias("cache_key")).agg(F.count("*").alias("hits"), F.min("event_id").alias("first_event"))


_SP = "(CASE WHEN {0} > 20 THEN {0} ELSE ln(1 + exp({0})) END)"
_A0, _A1 = "(12 * score - 4)", "(4 * score + len(purposes) + len(recipients) - 1)"


@query(
    "rk18_cascade",
    f"""{ctes('events', 'docs', 'statements', 'prefs')}, lastp AS (SELECT user_id, max_by(value, updated_at) AS value FROM prefs_in GROUP BY 1),
    keyed AS (SELECT e.*, {_JSON} AS cache_key, {twin.SKIP} AS skip, (lower(trim(p.value)) = 'opt-out' AND len(list_filter(purposes, lambda x: contains(lower(x), 'ads'))) > 0) IS TRUE AS blocked FROM events_in e LEFT JOIN lastp p USING (user_id)),
    guard AS (SELECT k.* EXCLUDE (data_categories), {twin.ENRICHED} AS data_categories, NOT skip AND NOT blocked AND action_type = 'Paste' AS hit, CASE WHEN len(k.data_categories) > 1 THEN 'deny' ELSE 'transform' END AS c_decision, round(0.2::DOUBLE * len(k.data_categories) + 0.1::DOUBLE * len(purposes), 6) AS c_risk FROM keyed k),
    {twin.LATEST}, {twin.CANDIDATES.format('(SELECT * FROM guard WHERE NOT skip AND NOT blocked AND NOT hit)')}, {twin.BM25}, {twin.KEYWORD}, {twin.HYBRID}, {twin.EVIDENCE},
    u AS (SELECT g.*, n_evidence, e1, e2, e3, e4, e5, e6, score, {twin.TIER} AS tier, round((1 + {_SP.format(_A1)}) / (2 + {_SP.format(_A0)} + {_SP.format(_A1)}), 9) AS fl, round(2 / (2 + {_SP.format(_A0)} + {_SP.format(_A1)}), 9) AS unc
      FROM guard g LEFT JOIN evd USING (event_id) LEFT JOIN (SELECT event_id, score FROM top WHERE rank = 1) t1 USING (event_id)),
    f AS (SELECT *, round(least(1.0::DOUBLE, (CASE WHEN n_evidence IS NULL THEN 1.0 WHEN unc < 0.25 THEN fl WHEN 'sell' IN actions THEN 0.9 WHEN len(purposes) > 0 THEN 0.2 ELSE 0.5 END)::DOUBLE * {twin.severity()} * {twin.TRANSPARENCY}), 12)::DOUBLE AS risk FROM u)
    SELECT event_id, CASE WHEN skip THEN 'allow' WHEN blocked THEN 'deny' WHEN hit THEN c_decision ELSE {twin.DECISION} END AS decision, (CASE WHEN skip THEN 0.0 WHEN blocked THEN 1.0 WHEN hit THEN c_risk ELSE risk END)::DOUBLE AS risk_score,
      CASE WHEN skip THEN 'triage_layer' WHEN blocked THEN 'consent_guardrail' WHEN hit THEN 'rule_fallback' WHEN n_evidence IS NULL THEN 'no_policy' WHEN unc < 0.25 THEN 'fast_system' WHEN 'sell' IN actions OR len(purposes) > 0 THEN 'llm_agent' ELSE 'rule_fallback' END AS system_used,
      CASE WHEN hit THEN 8 WHEN unc < 0.25 THEN 1 ELSE coalesce(n_evidence, 0) END::BIGINT AS n_evidence, cache_key, hit AS from_cache FROM f""",
)
def rk18_cascade(spark, sf):
    """The whole cascade: pasted behaviours are in the cache, an evidential head is the fast model, a client is asked where it is unsure and there are purposes or sales."""
    e, docs, statements, prefs = (frame(spark, sf, p) for p in ("events", "docs", "statements", "prefs"))
    paste = e.where("action_type = 'Paste'").join(decide.latest_preferences(prefs), "user_id", "left")
    n = F.size("data_categories")
    cache = paste.select(decide.cache_key().alias("cache_key"), F.when(n > 1, "deny").otherwise("transform").alias("decision"), F.round(0.2 * n + 0.1 * F.size("purposes"), 6).alias("risk_score"), F.lit("rule_fallback").alias("system_used"), F.lit(8).cast("long").alias("n_evidence")).distinct()

    def fast():
        score = F.col("top.score")
        return tuple(F.round(c, 9) for c in features.evidential(12 * score - 4, 4 * score + F.size("purposes") + F.size("recipients") - 1))

    def model(rows):
        wanted = F.col("needs_model") & (F.array_contains("actions", "sell") | (F.size("purposes") > 0))
        prompt = F.when(wanted, F.concat(F.array_join("actions", ","), F.lit(" for "), F.array_join("purposes", ",")))
        asked = models.ask(rows.withColumn("prompt", prompt), "prompt", "answer", _client)
        return asked.withColumn("llm_score", F.when(wanted, models.parsed_decision(F.col("answer"), F.array().cast("array<string>"))["risk_score"]))

    got = decide.decide(e, docs, statements, prefs, cache=cache, fast=fast, model=model, detailed=True, stored=True)
    return got.select("event_id", "decision", "risk_score", "system_used", "n_evidence", "cache_key", "from_cache")


def _client():
    return lambda prompt: '{"decision": "deny", "risk_score": 0.9}' if "sell" in prompt.split(" for ")[0].split(",") else '{"decision": "allow", "risk_score": 0.2}'


_CAND = f"{ctes('events', 'docs', 'statements')}, {twin.LATEST}, {twin.CANDIDATES.format('events_in')}"


def _matched(spark, sf):
    return retrieval.matched(frame(spark, sf, "events"), frame(spark, sf, "docs"))


def _candidates(spark, sf):
    return retrieval.candidates(*(frame(spark, sf, p) for p in ("events", "docs", "statements")))


@query("jn01_latest_policy", f"{ctes('events', 'docs')}, {twin.LATEST} SELECT domain, policy_doc_id, policy_domain FROM latest")
def jn01(spark, sf):
    return retrieval.latest_policy(frame(spark, sf, "events"), frame(spark, sf, "docs"))


_LIKE = "d.domain LIKE concat('%', e.domain, '%')"


@query("pf04_like_policy", f"{ctes('events', 'docs')}, {twin.LATEST.replace('contains(d.domain, e.domain)', _LIKE)} SELECT domain, policy_doc_id FROM latest")
def pf04(spark, sf):
    return retrieval.latest_policy(frame(spark, sf, "events"), frame(spark, sf, "docs"), like=True).select("domain", "policy_doc_id")


@query("rt01_candidates", f"{_CAND} SELECT event_id, policy_doc_id, s_id FROM cand")
def rt01(spark, sf):
    return _candidates(spark, sf).select("event_id", "policy_doc_id", "s_id")


@query("rt02_structured_score", f"{_CAND} SELECT event_id, s_id, round({twin.STRUCTURED}, 6)::DOUBLE AS score FROM cand")
def rt02(spark, sf):
    return _candidates(spark, sf).select("event_id", "s_id", F.round(retrieval.structured_score(), 6).alias("score"))


@query("rt04_bm25_index", f"{ctes('statements')}, {twin.BM25} SELECT policy_doc_id, id, token, round(weight, 6) AS weight FROM bm")
def rt04(spark, sf):
    return retrieval.bm25_index(frame(spark, sf, "statements")).withColumn("weight", F.round("weight", 6))


@query("rt05_keyword_scores", f"{_CAND}, {twin.BM25}, {twin.KEYWORD} SELECT event_id, s_id, round(keyword, 6) AS keyword FROM kw")
def rt05(spark, sf):
    return retrieval.keyword_scores(_matched(spark, sf), frame(spark, sf, "statements")).withColumn("keyword", F.round("keyword", 6))


@query("rt06_hybrid_top8", f"{_CAND}, {twin.BM25}, {twin.KEYWORD}, {twin.HYBRID} SELECT event_id, s_id, rank, score FROM top")
def rt06(spark, sf):
    x = retrieval.hybrid(_matched(spark, sf), frame(spark, sf, "statements"))
    return x.select("event_id", "s_id", F.col("rank").cast("long").alias("rank"), "score")


@query("pf01_triage", f"{EV} SELECT event_id, {twin.SKIP} AS skip, array_to_string({twin.ENRICHED}, ',') AS categories FROM events_in")
def pf01(spark, sf):
    return frame(spark, sf, "events").select("event_id", decide.skipped().alias("skip"), F.array_join(decide.enriched(), ",").alias("categories"))


@query("pf02_masked_tags", f"{EV} SELECT event_id, array_to_string({twin.found('masked', T.FIELD_PATTERNS)}, ',') AS tags FROM events_in")
def pf02(spark, sf):
    return frame(spark, sf, "events").select("event_id", F.array_join(X.found_terms(F.col("masked"), T.FIELD_PATTERNS), ",").alias("tags"))


@query("pf03_consent_guard", f"{ctes('events', 'prefs')}, {_GUARD} SELECT event_id, blocked FROM guard")
def pf03(spark, sf):
    p = decide.latest_preferences(frame(spark, sf, "prefs")).select("user_id", F.try_element_at("prefs", F.lit("consent.ads")).alias("ads_consent"))
    return frame(spark, sf, "events").join(p, "user_id", "left").select("event_id", decide.ads_blocked().alias("blocked"))


@query("pf05_valid_statements", f"{ctes('statements')} SELECT id FROM statements_in WHERE len(data_categories) > 0 OR len(actions) > 0")
def pf05(spark, sf):
    return frame(spark, sf, "statements").where((F.size("data_categories") > 0) | (F.size("actions") > 0)).select("id")


@query("pf08_evidence_projection", f"{ctes('statements')} SELECT concat(policy_doc_id, ':', id) AS evidence_id, coalesce(snippet, '') AS snippet, coalesce(rights_flag, false) AS rights_flag, coalesce(retention_mode, '') AS retention_mode FROM statements_in")
def pf08(spark, sf):
    return frame(spark, sf, "statements").select(F.concat_ws(":", "policy_doc_id", F.col("id").cast("string")).alias("evidence_id"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("rights_flag", F.lit(False)).alias("rights_flag"), F.coalesce("retention_mode", F.lit("")).alias("retention_mode"))


@query("jn03_statement_domain", f"{ctes('statements', 'docs')} SELECT s.id, d.domain FROM statements_in s LEFT JOIN docs_in d ON s.policy_doc_id = d.doc_id AND d.created_at > 20")
def jn03(spark, sf):
    d = frame(spark, sf, "docs").where("created_at > 20").select(F.col("doc_id").alias("policy_doc_id"), "domain")
    return frame(spark, sf, "statements").join(d, "policy_doc_id", "left").select("id", "domain")


@query("jn04_preferences", f"{ctes('prefs')} SELECT user_id, max_by(value, updated_at) AS ads FROM prefs_in GROUP BY 1")
def jn04(spark, sf):
    return decide.latest_preferences(frame(spark, sf, "prefs")).select("user_id", F.try_element_at("prefs", F.lit("consent.ads")).alias("ads"))


@query("jn15_foreign_categories", f"{ctes('statements')} SELECT id, array_to_string(list_sort(list_filter({T.VOCAB_DATA}, lambda x: NOT list_contains(data_categories, x))), ',') AS others FROM statements_in")
def jn15(spark, sf):
    return frame(spark, sf, "statements").select("id", F.array_join(F.sort_array(F.array_except(unrolled(T.VOCAB_DATA), F.col("data_categories"))), ",").alias("others"))


@query("sc22_evidence_rows", f"{ctes('statements')}, e AS (SELECT event_id AS decision_id, concat('d:', CASE WHEN event_id % 7 = 0 THEN 'x' ELSE (event_id % 1000)::VARCHAR END) AS e FROM events) SELECT decision_id, id AS policy_statement_id FROM e JOIN statements_in ON id = try_cast(substring(e, 3) AS BIGINT)")
def sc22(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("decision_id"), F.array(F.concat(F.lit("d:"), F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("event_id") % 1000).cast("string")))).alias("evidence_ids"))
    return readers.evidence_rows(d, frame(spark, sf, "statements"))


@query("sc25_unseen", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def sc25(spark, sf):
    done = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return readers.unseen(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), done, "o_orderkey")


def _hot(items: str, vocab: list[str]) -> str:
    """Multi-hot vector as text of 0 and 1."""
    names = f"{vocab}"
    low = f"{[v.lower() for v in vocab]}"
    i = f"coalesce(list_position({names}, trim(x)), list_position({low}, lower(trim(x))), list_position(list_transform({low}, lambda v: contains(lower(trim(x)), v)), true))"
    return f"array_to_string(list_transform(range(1, {len(vocab) + 1}), lambda k: CASE WHEN list_contains(list_transform({items}, lambda x: {i}), k) THEN 1 ELSE 0 END), '')"


@query("ml01_multi_hot", f"{EV} SELECT event_id, {_hot('data_categories', T.VOCAB_DATA)} || {_hot('actions', T.VOCAB_ACTIONS)} || {_hot('purposes', T.VOCAB_PURPOSES)} AS vector FROM events_in")
def ml01(spark, sf):
    v = features.behaviour_vector(*_cols("data_categories", "actions", "purposes"))
    return frame(spark, sf, "events").select("event_id", F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), "").alias("vector"))


def _said(name: str, col: str) -> str:
    return f"CASE WHEN len({col}) > 0 THEN '{name}: ' || array_to_string({col}, ', ') || '.' END"


@query("ml02_text_view", f"{EV}, t AS (SELECT event_id, concat_ws(' ', {_said('Data', 'data_categories')}, {_said('Actions', 'actions')}, {_said('Purposes', 'purposes')}) AS t FROM events_in) SELECT event_id, CASE WHEN t = '' THEN 'empty' ELSE t END AS view FROM t")
def ml02(spark, sf):
    return frame(spark, sf, "events").select("event_id", features.behaviour_text(*_cols("data_categories", "actions", "purposes")).alias("view"))


_W1 = [[0.5, -0.25, 0.1], [-0.3, 0.8, 0.2]]
_SP = "(CASE WHEN {0} > 20 THEN {0} ELSE ln(1 + exp({0})) END + 1)"
_H = [f"greatest(0.0, {w[0]} * l_quantity / 10 + {w[1]} * l_discount * 10 + {w[2]} * l_tax * 10 + {b})" for w, b in zip(_W1, (0.1, -0.2), strict=True)]


@query("ml04_evidential_head", f"WITH h AS (SELECT l_orderkey, l_linenumber, {_H[0]} AS h0, {_H[1]} AS h1 FROM lineitem), a AS (SELECT l_orderkey, l_linenumber, {_SP.format('h0')} AS a0, {_SP.format('h1')} AS a1 FROM h) SELECT l_orderkey, l_linenumber, round(a1 / (a0 + a1), 6) AS risk, round(2 / (a0 + a1), 6) AS uncertainty FROM a")
def ml04(spark, sf):
    x = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_tax") * 10)
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", features.dense(x, _W1, [0.1, -0.2], relu=True).alias("h"))
    r, u = features.evidential(F.col("h")[0], F.col("h")[1])
    return t.select("l_orderkey", "l_linenumber", F.round(r, 6).alias("risk"), F.round(u, 6).alias("uncertainty"))


_FOREIGN = f"list_filter({T.VOCAB_DATA}, lambda x: NOT list_contains(data_categories, x))"


@query(
    "ml11_behaviours",
    f"""{ctes('statements')}, v AS (SELECT *, ({_FOREIGN})[(('0x' || left(md5(id::VARCHAR), 8))::BIGINT % len({_FOREIGN})) + 1] AS other FROM statements_in WHERE len(data_categories) > 0 OR len(actions) > 0)
    SELECT id AS statement_id, 'compliant' AS kind, array_to_string(data_categories, ',') AS categories, array_to_string(purposes, ',') AS purposes FROM v
    UNION ALL SELECT id, 'violating', array_to_string(list_concat([other], data_categories[1:1]), ','), 'Unknown' FROM v
    UNION ALL SELECT id, 'ambiguous', array_to_string(data_categories[1:1], ','), '' FROM v""",
)
def ml11(spark, sf):
    return features.behaviours(frame(spark, sf, "statements")).select("statement_id", "kind", F.array_join("data_categories", ",").alias("categories"), F.array_join("purposes", ",").alias("purposes"))


@query("ml12_target_label", f"{_RISKS}, d AS (SELECT event_id, {twin.DECISION} AS d FROM r) SELECT event_id, CASE WHEN d = 'allow' THEN 0 ELSE 1 END AS label FROM d")
def ml12(spark, sf):
    return _risks(spark, sf).select("event_id", features.target_label(R.decision(*_cols("risk", "tier"))).alias("label"))
