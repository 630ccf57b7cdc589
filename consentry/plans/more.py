"""Queries of scans, set operations, joins and generators that the other modules do not cover."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..catalog import query
from ..functions import risk as R
from ..functions import tables as T
from ..functions import text as X
from ..operators import anonymize, contexts, guessing, retrieval
from ..operators import models as MD
from ..sources import readers
from . import text_twin as TT
from . import twin
from .inputs import ctes, frame, table

S, E, O = ctes("statements"), ctes("events"), ctes("outcomes")


@query("sc03_limited_scan", f"{ctes('docs')} SELECT doc_id, domain FROM docs_in ORDER BY doc_id LIMIT 20")
def sc03(spark, sf):
    """A limited scan; its limit is its argument, its order makes it the same everywhere."""
    return frame(spark, sf, "docs").select("doc_id", "domain").orderBy("doc_id").limit(20)


@query("sc04_in_list", f"{ctes('statements', 'docs')} SELECT id FROM statements_in WHERE policy_doc_id IN (SELECT doc_id FROM docs_in WHERE created_at < 30)")
def sc04(spark, sf):
    d = frame(spark, sf, "docs").where("created_at < 30").select(F.col("doc_id").alias("policy_doc_id"))
    return frame(spark, sf, "statements").join(d, "policy_doc_id", "left_semi").select("id")


@query("sc23_audit_rows", "SELECT event_id, CASE WHEN value > 50 THEN 'deny' ELSE 'allow' END AS decision, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n_ids FROM events")
def sc23(spark, sf):
    d = table(spark, sf, "events").select("ts", "event_id", F.when(F.col("value") > 50, "deny").otherwise("allow").alias("decision"), F.lit(0.5).alias("risk_score"), F.array(F.struct(F.lit("a:1").alias("evidence_id")), F.struct(F.when(F.col("event_id") % 2 == 1, "b:2").alias("evidence_id"))).alias("evidence"))
    return readers.audit_rows(d).select("event_id", "decision", F.size("evidence_ids").alias("n_ids"))


@query("se01_union_all", f"{ctes('statements', 'docs')} SELECT policy_doc_id AS doc_id, id, 'db' AS source FROM statements_in UNION ALL SELECT doc_id, created_at, 'public' FROM docs_in")
def se01(spark, sf):
    """Two whole sources with other columns under each other."""
    s = frame(spark, sf, "statements").select(F.col("policy_doc_id").alias("doc_id"), "id", F.lit("db").alias("source"))
    return s.unionByName(frame(spark, sf, "docs").select("doc_id", F.col("created_at").alias("id"), F.lit("public").alias("source")))


@query("se02_overlap_jaccard", f"{ctes('events')} SELECT a.event_id, len(list_intersect(list_distinct(a.data_categories), list_distinct(b.data_categories))) AS overlap, round(CASE WHEN len(list_distinct(list_concat(a.data_categories, b.data_categories))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a.data_categories), list_distinct(b.data_categories)))::DOUBLE / len(list_distinct(list_concat(a.data_categories, b.data_categories))) END, 6) AS jaccard FROM events_in a JOIN events_in b ON b.event_id = a.event_id + 1")
def se02(spark, sf):
    e = frame(spark, sf, "events").select("event_id", "data_categories")
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("data_categories").alias("other"))
    return e.join(b, "event_id").select("event_id", F.size(F.array_intersect("data_categories", "other")).cast("long").alias("overlap"), F.round(X.jaccard(F.col("data_categories"), F.col("other")), 6).alias("jaccard"))


_PHRASES = " UNION ALL ".join(f"SELECT conv_id, turn, '{c}' AS category, len(list_filter({[x.replace(chr(39), chr(39) * 2) for x in p]}, lambda p: contains(lower(text), p))) > 0 AS hit FROM conversations WHERE conv_id IS NOT NULL" for c, p in T.PHRASES.items())


@query("sn04_merged_categories", f"SELECT conv_id, turn, category, 'keyword' AS method FROM ({_PHRASES}) WHERE hit AND NOT (turn % 3 = 0 AND category = 'Health') UNION ALL SELECT conv_id, turn, 'Health', 'llm' FROM conversations WHERE conv_id IS NOT NULL AND turn % 3 = 0")
def sn04(spark, sf):
    """Keyword hits merged with a model's answer; the answer here is the stub of a category for every third turn."""
    c = table(spark, sf, "conversations").where("conv_id is not null")
    stub = F.when(F.col("turn") % 3 == 0, F.lit('{"categories": [{"category": "Health", "confidence": 0.9}, {"category": "Location", "confidence": 0.2}]}'))
    kw = F.transform(X.sensitive_phrases(F.col("text")), lambda x: F.struct(x["category"].alias("category"), x["confidence"].alias("confidence"), x["method"].alias("method")))
    empty = F.filter(kw, lambda x: F.lit(False))
    x = c.select("conv_id", "turn", F.explode(MD.merged(kw, empty, MD.sensitive(stub))).alias("c"))
    return x.select("conv_id", "turn", "c.category", "c.method")


@query("pf07_model_categories", f"{E}, c AS (SELECT event_id, unnest(data_categories) AS category, generate_subscripts(data_categories, 1) AS i FROM events_in) SELECT event_id, category FROM c WHERE (event_id + i) % 4 <> 0 AND ((event_id + i) % 10) / 10.0 > 0.3")
def pf07(spark, sf):
    """A model's answer on each event's own categories, with confidences of all tenths, some missing: those over 0.3 stay."""
    one = F.transform("data_categories", lambda c, i: F.concat(F.lit('{"category": "'), c, F.lit('"'), F.when((F.col("event_id") + i + 1) % 4 != 0, F.format_string(', "confidence": %.1f', (F.col("event_id") + i + 1) % 10 / F.lit(10.0))).otherwise(""), F.lit("}")))
    answer = F.concat(F.lit('<think>{"categories": []}</think> {"categories": ['), F.array_join(one, ", "), F.lit("]}"))
    return frame(spark, sf, "events").select("event_id", F.explode(MD.sensitive(answer)).alias("c")).select("event_id", "c.category")


@query(
    "lm02_parsed_decisions",
    f"""{E}, d AS (SELECT event_id, ['Allow', 'deny', 'TRANSFORM', 'ask', 'perhaps'][1 + len(actions) + event_id % 3] AS decision, event_id % 7 = 0 AS cut, CASE WHEN event_id % 5 > 0 THEN round((event_id % 100) / 100.0, 2) END AS score, data_categories AS cited FROM events_in),
    k AS (SELECT *, NOT cut AND lower(decision) IN ('allow', 'deny', 'transform', 'ask') AS ok FROM d)
    SELECT event_id, CASE WHEN ok THEN lower(decision) ELSE 'deny' END AS decision, (CASE WHEN ok THEN coalesce(score, 0.6) ELSE 0.7 END)::DOUBLE AS risk_score, CASE WHEN cut THEN 0 ELSE len(list_filter(cited, lambda x: x IN ('Health', 'Email', 'Contact', 'Location'))) END AS n_evidence FROM k""",
)
def lm02(spark, sf):
    """A model's decision on each event: in any case, with and without a score, with evidence that is not there, and cut off."""
    e = frame(spark, sf, "events")
    said = F.element_at(F.array(*map(F.lit, ("Allow", "deny", "TRANSFORM", "ask", "perhaps"))), (1 + F.size("actions") + F.col("event_id") % 3).cast("int"))
    score = F.when(F.col("event_id") % 5 > 0, F.format_string(', "risk_score": %.2f', F.col("event_id") % 100 / F.lit(100.0))).otherwise("")
    whole = F.concat(F.lit('Sure. {"decision": "'), said, F.lit('"'), score, F.lit(', "evidence": '), X.json_list(F.col("data_categories")), F.lit("}"))
    answer = F.when(F.col("event_id") % 7 == 0, F.left(whole, F.length(whole) - 1)).otherwise(whole)
    x = e.select("event_id", MD.parsed_decision(answer, F.array(*map(F.lit, ("Health", "Email", "Contact", "Location")))).alias("p"))
    return x.select("event_id", "p.decision", "p.risk_score", F.size("p.evidence").alias("n_evidence"))


def _contexts_sql(all_) -> str:
    """Rows of in_contexts in DuckDB."""
    one = lambda c, e: f"{{'context': '{c.name}', 'recipients': ['{c.recipient}'], 'purposes': ['{c.purpose}'], 'actions': ['{c.action}'], 'action_type': '{c.action_type}', 'n': {int(c.evidence is not None)}, 'e1': {len(e.snippet) >= 50}, 'shown': {list(e.data_categories)}::VARCHAR[], 'why': {list(e.purposes)}::VARCHAR[], 'e4': {e.legal}, 'e5': {e.rights}, 'e6': {e.retention}}}"
    rows = ", ".join(one(c, c.evidence or contexts.Evidence()) for c in all_)
    less = " - ".join(f"(CASE WHEN {test} THEN {w} ELSE 0 END)::DOUBLE" for test, w in (("e1", 0.1), ("list_has_any(shown, data_categories)", 0.15), ("list_has_any(why, purposes)", 0.1), ("e4", 0.08), ("e5", 0.05), ("e6", 0.02)))
    z = f"((risk - {twin.ALLOW}) / ({twin.DENY} - {twin.ALLOW}))"
    return f"""{E}, c AS (SELECT unnest([{rows}], recursive := true)), x AS (SELECT e.data_categories, c.* FROM events_in e CROSS JOIN c),
    s AS (SELECT context, {twin.TIER} AS tier, round(least(1.0::DOUBLE, 0.7::DOUBLE * {twin.severity()} * (CASE WHEN n = 0 THEN 1.3 ELSE greatest(0.8::DOUBLE, 1.3::DOUBLE - {less}) END)::DOUBLE), 12) AS risk FROM x),
    l AS (SELECT context, tier, risk, {twin.DECISION} AS decision, CASE WHEN risk < 0.5 THEN 1 WHEN risk < 0.7 THEN 2 WHEN risk < 0.85 THEN 3 ELSE 4 END AS level, CASE WHEN risk < {twin.ALLOW} THEN 1 WHEN risk >= {twin.DENY} THEN 4 WHEN {z} < 0.25 THEN 1 WHEN {z} < 0.5 THEN 2 WHEN {z} < 0.75 THEN 3 ELSE 4 END AS banded_level FROM s)
    SELECT context, tier, decision, level, banded_level, count(*) AS n, round(sum(risk), 6) AS risk FROM l GROUP BY ALL"""


@query("rk16_contexts", f"""{E}, c AS (SELECT unnest([{{'context': 'trusted', 'recipients': ['first_party'], 'purposes': ['functionality'], 't': 0.8}}, {{'context': 'analytics', 'recipients': ['analytics'], 'purposes': ['analytics'], 't': 1.0}}, {{'context': 'ads', 'recipients': ['advertising'], 'purposes': ['advertising'], 't': 1.3}}], recursive := true)),
  s AS (SELECT context, {twin.TIER} AS tier, round(least(1.0::DOUBLE, 0.7::DOUBLE * {twin.severity()} * t::DOUBLE), 12) AS risk FROM (SELECT e.event_id, e.data_categories, e.actions, e.action_type, c.* FROM events_in e CROSS JOIN c))
  SELECT context, {twin.DECISION} AS decision, count(*) AS n FROM s GROUP BY ALL""")
def rk16(spark, sf):
    """Every event in three contexts: a fixed array is exploded, nothing is joined."""
    contexts = (("trusted", "first_party", "functionality", 0.8), ("analytics", "analytics", "analytics", 1.0), ("ads", "advertising", "advertising", 1.3))
    c = F.array(*[F.struct(F.lit(n).alias("context"), F.array(F.lit(r)).alias("r"), F.array(F.lit(p)).alias("p"), F.lit(t).alias("t")) for n, r, p, t in contexts])
    x = frame(spark, sf, "events").select("data_categories", "actions", "action_type", F.explode(c).alias("c"))
    x = x.withColumns({"tier": R.decision_tier(F.col("data_categories")), "s": R.severity(F.col("data_categories"), F.col("actions"), F.col("c.p"), F.col("c.r"), F.col("action_type"))})
    x = x.withColumn("risk", F.round(R.risk(F.lit(0.7), F.col("s"), F.col("c.t")), 12))
    return x.groupBy(F.col("c.context").alias("context"), R.decision(F.col("risk"), F.col("tier")).alias("decision")).agg(F.count("*").alias("n"))


@query(
    "rk16_contexts_with_evidence",
    _contexts_sql(contexts.CONTROL + contexts.BAND),
)
def rk16_evidence(spark, sf):
    """Every event in the eight contexts of both studies, each with what its policy shows."""
    x = contexts.in_contexts(frame(spark, sf, "events").select("data_categories"), contexts.CONTROL + contexts.BAND)
    return x.groupBy("context", "tier", "decision", "level", "banded_level").agg(F.count("*").alias("n"), F.round(F.sum("risk"), 6).alias("risk"))


@query(
    "rk19_policy_risk",
    f"""{ctes('events', 'docs')}, {twin.LATEST}, p AS (SELECT e.*, {twin.TIER} AS tier, pg.html FROM events_in e JOIN latest l USING (domain) JOIN pages pg ON pg.page_id::VARCHAR = l.policy_doc_id),
    r AS (SELECT event_id, tier, round(least(1.0::DOUBLE, 0.7::DOUBLE * {twin.severity()} * greatest(0.8::DOUBLE, 1.3::DOUBLE - (CASE WHEN length(html) >= 50 THEN 0.1 ELSE 0 END)::DOUBLE - (CASE WHEN len(data_categories) > 0 THEN 0.15 ELSE 0 END)::DOUBLE - (CASE WHEN len(purposes) > 0 THEN 0.1 ELSE 0 END)::DOUBLE - (CASE WHEN contains(lower(html), 'consent') THEN 0.08 ELSE 0 END)::DOUBLE)), 12) AS risk FROM p)
    SELECT event_id, risk, {twin.DECISION} AS decision FROM r""",
)
def rk19_risk(spark, sf):
    """Each event's risk under the text of its latest policy."""
    met = retrieval.matched(frame(spark, sf, "events"), frame(spark, sf, "docs"))
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("policy_doc_id"), "html")
    return contexts.policy_risk(met.join(pages, "policy_doc_id"), "html").select("event_id", "risk", "decision")


@query("rk19_policy_signals", "SELECT page_id, contains(lower(html), 'consent') OR contains(lower(html), 'legitimate interest') OR contains(lower(html), 'legal basis') AS legal, contains(lower(html), 'your rights') OR contains(lower(html), 'opt out') OR contains(lower(html), 'opt-out') OR contains(lower(html), 'delete your') AS rights, contains(lower(html), 'retain') OR contains(lower(html), 'retention') AS retention FROM pages")
def rk19(spark, sf):
    return table(spark, sf, "pages").select("page_id", *(c.alias(k) for k, c in MD.presence(F.col("html")).items()))


@query("jn14_least_risk_template", f"{E}, t AS (SELECT unnest([{{'k': 0, 'template': 'Email', 'w': 0.55}}, {{'k': 1, 'template': 'Health', 'w': 0.95}}, {{'k': 2, 'template': 'cookies', 'w': 0.2}}], recursive := true)), d AS (SELECT event_id, template, k, abs(({twin.SENSITIVITY})::DOUBLE - w::DOUBLE) AS d FROM events_in CROSS JOIN t) SELECT event_id, template FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(d, 9), k) AS r FROM d) WHERE r = 1")
def jn14(spark, sf):
    s = R.data_sensitivity(F.col("data_categories"))
    t = F.array(*[F.struct(F.round(F.abs(s - w), 9).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("template")) for k, (n, w) in enumerate((("Email", 0.55), ("Health", 0.95), ("cookies", 0.2)))])
    return frame(spark, sf, "events").select("event_id", F.array_min(t)["template"].alias("template"))


@query("ag04_category_means", f"{O} SELECT grp, gold_label, count(*) AS n, round(avg(x), 6) AS utility, round(avg(y), 6) AS privacy FROM outcomes_in GROUP BY ALL")
def ag04(spark, sf):
    return frame(spark, sf, "outcomes").groupBy("grp", "gold_label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("utility"), F.round(F.avg("y"), 6).alias("privacy"))


@query("ag26_consensus", f"{O} SELECT unit, round(avg(x), 6) AS x, round(avg(CASE WHEN y > 0.3 THEN y END), 6) AS y FROM outcomes_in GROUP BY 1")
def ag26(spark, sf):
    return frame(spark, sf, "outcomes").groupBy("unit").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg(F.when(F.col("y") > 0.3, F.col("y"))), 6).alias("y"))


@query("ag28_dominant_label", f"{O}, c AS (SELECT unit, count(*) FILTER (gold = 1) AS a, count(*) FILTER (gold = 0) AS b FROM outcomes_in GROUP BY 1) SELECT unit, CASE WHEN a > b THEN 'Relevant' ELSE 'Irrelevant' END AS label FROM c")
def ag28(spark, sf):
    """Ties count as irrelevant."""
    c = frame(spark, sf, "outcomes").groupBy("unit").agg(F.count_if(F.col("gold") == 1).alias("a"), F.count_if(F.col("gold") == 0).alias("b"))
    return c.select("unit", F.when(F.col("a") > F.col("b"), "Relevant").otherwise("Irrelevant").alias("label"))


@query("ag29_corpus_statistics", f"{S}, {twin.BM25} SELECT p.policy_doc_id, p.n, round(p.avgdl, 6) AS avgdl, count(*) AS terms FROM per_doc p JOIN dfs USING (policy_doc_id) GROUP BY ALL")
def ag29(spark, sf):
    from ..operators import retrieval

    t = frame(spark, sf, "statements").select("policy_doc_id", X.tokens(retrieval.statement_text()).alias("t"))
    n = t.groupBy("policy_doc_id").agg(F.count("*").alias("n"), F.round(F.avg(F.size("t")), 6).alias("avgdl"))
    return n.join(t.select("policy_doc_id", F.explode("t").alias("w")).groupBy("policy_doc_id").agg(F.count_distinct("w").alias("terms")), "policy_doc_id")


@query("wn03_max_normalised", f"{O} SELECT key, round(x / CASE WHEN max(x) OVER w = 0 THEN 1.0 ELSE max(x) OVER w END, 9) AS v FROM outcomes_in WINDOW w AS (PARTITION BY unit)")
def wn03(spark, sf):
    m = F.max("x").over(W.Window.partitionBy("unit"))
    return frame(spark, sf, "outcomes").select("key", F.round(F.col("x") / F.when(m == 0, 1.0).otherwise(m), 9).alias("v"))


@query("wn10_first_by_length", "SELECT source, min(doc_id) FILTER (length(text) BETWEEN 200 AND 800) AS short, min(doc_id) AS first FROM documents GROUP BY 1")
def wn10(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.min(F.when(F.length("text").between(200, 800), F.col("doc_id"))).alias("short"), F.min("doc_id").alias("first"))


@query("an19_attribute_match", "SELECT a.s_suppkey, contains(lower(a.s_name), lower(n.n_name)) OR contains(lower(n.n_name), lower(a.s_name)) OR list_has_any(list_filter(regexp_split_to_array(lower(a.s_name), '[\\s,]+'), lambda w: length(w) > 2), list_filter(regexp_split_to_array(lower(n.n_name), '[\\s,]+'), lambda w: length(w) > 2)) OR list_has_any(regexp_extract_all(a.s_name, '\\d+'), regexp_extract_all(n.n_name, '\\d+')) AS matches FROM supplier a JOIN nation n ON a.s_nationkey = n.n_nationkey")
def an19(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf, "supplier").join(n, "s_nationkey").select("s_suppkey", MD.attribute_match(F.col("s_name"), F.col("n_name")).alias("matches"))


@query("an16_config_runner", f"SELECT config, count(*) AS n, round(avg(length(t)), 6) AS mean_length FROM (SELECT 'none' AS config, text AS t FROM conversations UNION ALL SELECT 'cut', left(text, 100) FROM conversations) GROUP BY 1")
def an16(spark, sf):
    """Every text under every configuration, in one long table."""
    configs = F.array(F.struct(F.lit("none").alias("config"), F.col("text").alias("t")), F.struct(F.lit("cut").alias("config"), F.left("text", F.lit(100)).alias("t")))
    x = table(spark, sf, "conversations").select(F.explode(configs).alias("c")).select("c.*")
    return x.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg(F.length("t")), 6).alias("mean_length"))


_NEXT = "WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations), g AS (SELECT *, regexp_extract_all(next, '[A-Za-z]{3,}') AS w FROM n WHERE next IS NOT NULL)"
_FITS = "(contains(lower(text), lower({0})) OR list_has_any([lower({0})], list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2)))"


@query(
    "an11_guesser_fold",
    f"""{_NEXT}, k AS (SELECT conv_id, turn, CASE WHEN len(w) > 0 AND {_FITS.format('w[1]')} THEN 0.4 END AS a, CASE WHEN len(w) > 0 AND {_FITS.format('w[-1]')} THEN (turn % 10) / 10.0 END AS b, len(w) AS n FROM g)
    SELECT conv_id, turn, (CASE WHEN a IS NULL AND b IS NULL THEN 0 ELSE greatest(coalesce(a, 0), coalesce(b, 0), 0.55) END)::DOUBLE AS confidence, (a IS NOT NULL OR b IS NOT NULL) AND greatest(coalesce(a, 0), coalesce(b, 0), 0.55) >= 0.6 AS can_identify, greatest(CASE WHEN n > 0 THEN greatest(0.4, (turn % 10) / 10.0) ELSE 0 END, 0.55)::DOUBLE AS unverified FROM k""",
)
def an11(spark, sf):
    """Guesses of the next turn's first and last word, verified by the turn; unverified: the same without an original."""
    c = table(spark, sf, "conversations").withColumn("next", F.lead("text").over(W.Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    w = F.regexp_extract_all("next", F.lit("[A-Za-z]{3,}"), F.lit(0))
    one = lambda word, confidence: F.struct(word.alias("guess"), confidence.alias("confidence"))
    guesses = F.when(F.size("w") > 0, F.array(one(F.get("w", F.lit(0)), F.lit(0.4)), one(F.get("w", F.size("w") - 1), F.col("turn") % 10 / F.lit(10.0)))).otherwise(F.array().cast("array<struct<guess:string,confidence:double>>"))
    x = c.withColumn("w", w).withColumn("answer", F.to_json(F.struct(guesses.alias("guesses"), F.lit(0.55).alias("max_confidence"))))
    x = x.select("conv_id", "turn", guessing.guessed(F.col("answer"), F.col("text")).alias("g"), guessing.guessed(F.col("answer")).alias("u"))
    return x.select("conv_id", "turn", "g.confidence", "g.can_identify", F.col("u.confidence").alias("unverified"))


_CANDIDATE = "CASE doc_id % 4 WHEN 0 THEN l3 WHEN 1 THEN '  ' || text || ' ' WHEN 2 THEN coalesce(text, '') || ' and more' END"


@query(
    "an06_accepted_rewrite",
    f"""WITH {TT.PATTERNS}, lv AS (SELECT doc_id, text, rx, {TT.levels('rx')} FROM rx), c AS (SELECT doc_id, text, rx, l3, trim(coalesce({_CANDIDATE}, '')) AS c FROM lv)
    SELECT doc_id, md5(CASE WHEN c = '' OR (lower(c) = lower(trim(text)) AND l3 <> text) OR len(list_filter(rx, lambda x: contains(lower(c), lower(x.v)))) > 0 THEN l3 ELSE c END) AS digest FROM c""",
)
def an06(spark, sf):
    """A rewrite of each document - its masked text, an echo, one that leaves every identifier, none - or the masked text in its place."""
    x = anonymize.levels(table(spark, sf, "documents").select("doc_id", "text"))
    n = F.col("doc_id") % 4
    candidate = F.when(n == 0, F.col("l3")).when(n == 1, F.concat(F.lit("  "), "text", F.lit(" "))).when(n == 2, F.concat(F.coalesce("text", F.lit("")), F.lit(" and more")))
    return x.select("doc_id", F.md5(MD.accepted(candidate, F.col("text"), F.col("l3"), F.col("entities"), F.lit(4))).alias("digest"))


_VARIANTS = (("full", True, "allow"), ("private", True, "allow"), ("minimal", True, "allow"), ("shared", False, "deny"), ("sold", False, "deny"), ("unknown", False, "deny"))


@query("ml09_contrastive_variants", f"{S} SELECT id, v.kind, v.safe, CASE WHEN v.safe THEN 0 ELSE 1 END AS label FROM statements_in CROSS JOIN (SELECT unnest([" + ", ".join(f"{{'kind': '{k}', 'safe': {str(s).lower()}}}" for k, s, _ in _VARIANTS) + "], recursive := true)) v WHERE len(data_categories) > 0")
def ml09(spark, sf):
    v = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("safe"), F.lit(d).alias("decision")) for k, s, d in _VARIANTS])
    from ..operators import features

    x = frame(spark, sf, "statements").where(F.size("data_categories") > 0).select("id", F.explode(v).alias("v"))
    return x.select("id", "v.kind", "v.safe", features.target_label(F.col("v.decision")).alias("label"))


@query("ml13_pairs_per_category", f"{S}, g AS (SELECT id, array_to_string(list_sort(data_categories), '+') AS cats FROM statements_in), r AS (SELECT *, row_number() OVER (PARTITION BY cats ORDER BY md5('42|' || id), id) AS r FROM g) SELECT cats, id, r FROM r WHERE r <= 50")
def ml13(spark, sf):
    """At most fifty statements of each set of categories, in hash order: the limit is the operator's."""
    g = frame(spark, sf, "statements").select("id", F.array_join(F.sort_array("data_categories"), "+").alias("cats"))
    w = W.Window.partitionBy("cats").orderBy(F.md5(F.concat(F.lit("42|"), F.col("id").cast("string"))), "id")
    return g.withColumn("r", F.row_number().over(w).cast("long")).where("r <= 50").select("cats", "id", "r")


@query("ml14_scenarios", "SELECT s_nationkey AS template, k.kind, row_number() OVER (PARTITION BY s_nationkey, k.kind ORDER BY s_suppkey) - 1 AS n, CASE k.kind WHEN 'compliant' THEN 'allow' WHEN 'violating' THEN 'deny' ELSE 'transform' END AS expected FROM supplier CROSS JOIN (SELECT unnest(['compliant', 'violating', 'ambiguous']) AS kind) k")
def ml14(spark, sf):
    """Scenarios of each kind, numbered within a template; nations stand in for templates, their suppliers for what fills them."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("template"), "s_suppkey", F.explode(F.array(*map(F.lit, ("compliant", "violating", "ambiguous")))).alias("kind"))
    number = F.row_number().over(W.Window.partitionBy("template", "kind").orderBy("s_suppkey")) - 1
    return s.select("template", "kind", number.cast("long").alias("n"), F.when(F.col("kind") == "compliant", "allow").when(F.col("kind") == "violating", "deny").otherwise("transform").alias("expected"))


@query("st06_hourly_usage", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def st06(spark, sf):
    """The batch form of the streaming usage table (an extension)."""
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("lm07_shuffled_method_codes", "SELECT s.s_suppkey AS sample_id, m.method, chr((64 + row_number() OVER (PARTITION BY s.s_suppkey ORDER BY md5('42|' || s.s_suppkey || '|' || m.method)))::INT) AS code FROM supplier s CROSS JOIN (SELECT unnest(['ours', 'ner', 'llm']) AS method) m")
def lm07(spark, sf):
    """Blind codes A, B, C for the methods of each sample, shuffled by md5."""
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.explode(F.array(*map(F.lit, ("ours", "ner", "llm")))).alias("method"))
    w = W.Window.partitionBy("sample_id").orderBy(F.md5(F.concat_ws("|", F.lit("42"), F.col("sample_id").cast("string"), "method")))
    return m.withColumn("code", F.char(64 + F.row_number().over(w)))


_FOLD = "CASE WHEN acc.full THEN acc WHEN acc.t = '' THEN {'t': x.t, 'full': false} WHEN length(acc.t) + 1 + length(x.t) <= 200 THEN {'t': acc.t || ' ' || x.t, 'full': false} ELSE {'t': acc.t, 'full': true} END"


@query("an20_first_sentences", r"WITH s AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM conversations) SELECT conv_id, turn, list_reduce(list_transform(s, lambda p: {'t': p, 'full': false}), lambda acc, x: " + _FOLD + ", {'t': '', 'full': false}).t AS head FROM s")
def an20(spark, sf):
    """Sentences of a text as long as their sum stays within 200 characters; at least the first."""
    s = F.split("text", r"(?<=[.!?])\s+")
    kept = F.aggregate(s, F.struct(F.lit("").alias("t"), F.lit(False).alias("full")), lambda acc, x: F.when(acc["full"], acc).when(acc["t"] == "", F.struct(x.alias("t"), F.lit(False).alias("full"))).when(F.length(acc["t"]) + 1 + F.length(x) <= 200, F.struct(F.concat_ws(" ", acc["t"], x).alias("t"), F.lit(False).alias("full"))).otherwise(F.struct(acc["t"].alias("t"), F.lit(True).alias("full"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", kept["t"].alias("head"))


@query("ml10_text_pairs", f"{S}, t AS (SELECT id, array_to_string(list_sort(data_categories), '+') AS cats FROM statements_in), n AS (SELECT id, cats, coalesce(lead(id) OVER (PARTITION BY cats ORDER BY md5('42|' || id), id), first(id) OVER (PARTITION BY cats ORDER BY md5('42|' || id), id)) AS partner FROM t) SELECT id AS a, partner AS b, cats FROM n WHERE partner <> id")
def ml10(spark, sf):
    """Each statement with the next one of its categories in hash order, around a ring: positive pairs without a join of all pairs."""
    t = frame(spark, sf, "statements").select("id", F.array_join(F.sort_array("data_categories"), "+").alias("cats"))
    w = W.Window.partitionBy("cats").orderBy(F.md5(F.concat(F.lit("42|"), F.col("id").cast("string"))), "id")
    return t.select(F.col("id").alias("a"), F.coalesce(F.lead("id").over(w), F.first("id").over(w)).alias("b"), "cats").where("a <> b")


@query("ag10_precision_recall_nan", f"{O}, c AS (SELECT unit, count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 1) AS fp, count(*) FILTER (gold = 1 AND pred = 0) AS fn FROM outcomes_in GROUP BY 1) SELECT unit, CASE WHEN tp + fp = 0 THEN 'NaN' ELSE round(tp / (tp + fp), 6)::VARCHAR END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 'NaN' ELSE round(tp / (tp + fn), 6)::VARCHAR END::DOUBLE AS recall FROM c")
def ag10(spark, sf):
    g, p = F.col("gold") == 1, F.col("pred") == 1
    c = frame(spark, sf, "outcomes").groupBy("unit").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    share = lambda d: F.when(d == 0, F.lit(float("nan"))).otherwise(F.round(F.try_divide(F.col("tp"), d), 6))
    return c.select("unit", share(F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp") + F.col("fn")).alias("recall"))


@query("jn09_ratings_to_methods", f"WITH k AS (SELECT s_suppkey AS sample_id, chr((65 + s_suppkey % 2)::INT) AS code, 'ours' AS method FROM supplier), r AS (SELECT l_suppkey AS sample_id, 'A' AS code, l_quantity AS rating FROM lineitem) SELECT method, count(*) AS n, round(avg(rating), 6) AS mean FROM r JOIN k USING (sample_id, code) GROUP BY 1")
def jn09(spark, sf):
    k = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.char((65 + F.col("s_suppkey") % 2).cast("int")).alias("code"), F.lit("ours").alias("method"))
    r = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.lit("A").alias("code"), F.col("l_quantity").alias("rating"))
    return r.join(k, ["sample_id", "code"]).groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean"))


@query("jn10_aligned_annotations", f"{O} SELECT a.key, a.gold_label AS first, b.gold_label AS second FROM outcomes_in a LEFT JOIN (SELECT unit, max({{'k': key, 'l': gold_label}}).l AS gold_label FROM outcomes_in WHERE gold_label <> 'allow' GROUP BY 1) b USING (unit)")
def jn10(spark, sf):
    """Annotations aligned to the last one of the unit by another rater; missing ones are null."""
    o = frame(spark, sf, "outcomes")
    b = o.where("gold_label <> 'allow'").groupBy("unit").agg(F.max(F.struct("key", "gold_label"))["gold_label"].alias("second"))
    return o.join(b, "unit", "left").select("key", F.col("gold_label").alias("first"), "second")
