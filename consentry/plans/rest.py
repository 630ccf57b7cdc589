"""Queries of lookups, positional and profile joins, further metrics, ablations, prompts and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..catalog import query
from ..functions import risk as R
from ..functions import text as X
from ..operators import features, models
from ..operators import metrics as M
from ..sources import readers
from . import twin
from .inputs import ctes, frame, table
from .policies import _RISKS, _cols, _risks

O, EV = ctes("outcomes"), ctes("events")
LABELS = ["allow", "deny", "transform"]
_ONCE = "SELECT event_id, event_type, value FROM events WHERE event_id = 7"


@query("sc02_point_lookup", _ONCE)
def sc02(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return spark.createDataFrame([readers.lookup(e, "event_id", 7)], e.schema)


@query("pf06_configured", f"{O} SELECT key, gold_label IN ('allow', 'deny') AS wanted, pred_label <> 'allow' AS needs_model FROM outcomes_in WHERE starts_with(grp, 'N') AND pred_label IN ('deny', 'transform')")
def pf06(spark, sf):
    o = frame(spark, sf, "outcomes").where(F.startswith("grp", F.lit("N")) & F.col("pred_label").isin("deny", "transform"))
    return o.select("key", F.col("gold_label").isin("allow", "deny").alias("wanted"), (F.col("pred_label") != "allow").alias("needs_model"))


@query("jn07_by_position", f"{O}, a AS (SELECT unit, key, row_number() OVER (PARTITION BY unit ORDER BY key) AS i FROM outcomes_in WHERE gold = 1), b AS (SELECT unit, x, row_number() OVER (PARTITION BY unit ORDER BY key DESC, x) AS i FROM outcomes_in) SELECT key, x FROM a JOIN b USING (unit, i)")
def jn07(spark, sf):
    """Rows of two lists of a unit, side by side up to the shorter one."""
    o = frame(spark, sf, "outcomes")
    at = lambda *order: F.row_number().over(W.Window.partitionBy("unit").orderBy(*order)).alias("i")
    return o.where("gold = 1").select("unit", "key", at("key")).join(o.select("unit", "x", at(F.desc("key"), "x")), ["unit", "i"]).select("key", "x")


@query("jn08_profiles", "SELECT e.event_id, CASE e.event_id % 3 WHEN 0 THEN 'segment' WHEN 1 THEN 'nation' ELSE 'age' END AS feature, CASE e.event_id % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_nationkey::VARCHAR END AS truth, l.quality AS likeness FROM events e JOIN customer c ON c_custkey = e.user_id LEFT JOIN labels l ON l.doc_id = e.event_id")
def jn08(spark, sf):
    """Results with what the person's profile says of the feature asked about, and a likeness where one was computed."""
    profile = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("profile"))
    e = table(spark, sf, "events").select("event_id", "user_id", F.get(F.array(F.lit("segment"), F.lit("nation"), F.lit("age")), (F.col("event_id") % 3).cast("int")).alias("feature"))
    scores = table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"), F.col("quality").alias("likeness"))
    return e.join(profile, "user_id").join(scores, "event_id", "left").select("event_id", "feature", F.try_element_at("profile", F.col("feature")).alias("truth"), "likeness")


_FL = f"{O}, l AS (SELECT unnest(['allow', 'deny', 'transform']) AS label), c AS (SELECT label, count(*) FILTER (gold_label = label AND pred_label = label) AS tp, count(*) FILTER (pred_label = label) AS p, count(*) FILTER (gold_label = label) AS g FROM l CROSS JOIN outcomes_in GROUP BY 1), r AS (SELECT label, tp / greatest(1, p) AS a, tp / greatest(1, g) AS b FROM c), f AS (SELECT label, a, b, 2 * a * b / greatest(1e-9, a + b) AS f FROM r)"


@query("ag09_fixed_labels", f"{_FL} SELECT label, round(a, 6) AS precision, round(b, 6) AS recall, round(f, 6) AS f1 FROM f UNION ALL SELECT 'macro', round(avg(a), 6), round(avg(b), 6), round(avg(f), 6) FROM f")
def ag09(spark, sf):
    per = M.fixed_labels(frame(spark, sf, "outcomes"), "gold_label", "pred_label", LABELS)
    macro = per.agg(F.lit("macro").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return per.unionByName(macro).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("ag10_f1_nan", f"{O}, c AS (SELECT unit, count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (pred = 1) AS p, count(*) FILTER (gold = 1) AS g FROM outcomes_in GROUP BY 1) SELECT unit, CASE WHEN tp > 0 THEN round(2.0 * tp / (p + g), 6) ELSE 'NaN'::DOUBLE END::DOUBLE AS f1 FROM c")
def ag10(spark, sf):
    """F1 per unit; not a number where precision or recall is none or zero."""
    g, p = F.col("gold") == 1, F.col("pred") == 1
    c = frame(spark, sf, "outcomes").groupBy("unit").agg(F.count_if(g & p).alias("tp"), F.count_if(p).alias("p"), F.count_if(g).alias("g"))
    return c.select("unit", F.when(F.col("tp") > 0, F.round(2.0 * F.col("tp") / (F.col("p") + F.col("g")), 6)).otherwise(float("nan")).alias("f1"))


_U = "2 / (2 + CASE WHEN a > 20 THEN a ELSE ln(1 + exp(a)) END + CASE WHEN b > 20 THEN b ELSE ln(1 + exp(b)) END)"


@query("ag19_escalation", f"{O}, u AS (SELECT grp, {_U} AS u FROM (SELECT grp, x * 4 AS a, y * 2 - 3 AS b FROM outcomes_in)) SELECT grp, round(avg((u >= 0.35)::INT), 6) AS escalated, round(avg(u), 6) AS uncertainty FROM u GROUP BY 1")
def ag19(spark, sf):
    _, u = features.evidential(F.col("x") * 4, F.col("y") * 2 - 3)
    return frame(spark, sf, "outcomes").select("grp", u.alias("u")).groupBy("grp").agg(F.round(F.avg((F.col("u") >= 0.35).cast("int")), 6).alias("escalated"), F.round(F.avg("u"), 6).alias("uncertainty"))


@query(
    "ag25_ordinal",
    f"""{O}, o AS (SELECT grp, unit, (y * 10)::INT % 5 AS v FROM outcomes_in), m AS (SELECT grp, unit, count(*) AS m FROM o GROUP BY ALL HAVING count(*) > 1),
    r AS (SELECT o.*, m FROM o JOIN m USING (grp, unit)), n AS (SELECT grp, v, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT grp, unit, v, m, count(*) AS k FROM r GROUP BY ALL),
    dist AS (SELECT a.grp, a.v AS v, b.v AS w, a.n AS nv, b.n AS nw, pow((SELECT sum(x.n) FROM n x WHERE x.grp = a.grp AND x.v BETWEEN least(a.v, b.v) AND greatest(a.v, b.v)) - (a.n + b.n) / 2.0, 2) AS d FROM n a JOIN n b ON a.grp = b.grp AND a.v <> b.v),
    ob AS (SELECT a.grp, sum(a.k * b.k / (a.m - 1) * d) AS ob FROM c a JOIN c b ON a.grp = b.grp AND a.unit = b.unit AND a.v <> b.v JOIN dist ON dist.grp = a.grp AND dist.v = a.v AND dist.w = b.v GROUP BY 1),
    ex AS (SELECT dist.grp, sum(nv * nw * d) / (any_value(t) - 1) AS ex FROM dist JOIN (SELECT grp, sum(n) AS t FROM n GROUP BY 1) USING (grp) GROUP BY 1)
    SELECT grp, round(1 - ob / ex, 6) AS alpha FROM ob JOIN ex USING (grp)""",
)
def ag25(spark, sf):
    o = frame(spark, sf, "outcomes").withColumn("v", F.round(F.col("y") * 10).cast("int") % 5)
    return M.krippendorff_ordinal(o, "unit", "v", ["grp"]).select("grp", F.round("alpha", 6).alias("alpha"))


@query("rk12_spr", f"""{_RISKS} SELECT event_id, round(0.30::DOUBLE * l + 0.25::DOUBLE * sev + 0.15::DOUBLE * list_has_any(actions, ['Share', 'Transfer'])::INT + 0.10::DOUBLE * list_has_any(purposes, ['Advertising', 'Marketing', 'Unknown'])::INT + 0.20::DOUBLE * (CASE WHEN event_id % 3 <> 0 THEN 0.0 ELSE 0.3 END)::DOUBLE, 10) AS spr FROM r""")
def rk12(spark, sf):
    return _risks(spark, sf).select("event_id", F.round(R.spr(*_cols("l", "sev", "actions", "purposes"), F.col("event_id") % 3 != 0), 10).alias("spr"))


@query("rk08_more_ablations", f"""{_RISKS} SELECT event_id, round(least(1.0::DOUBLE, l * sev), 12) AS no_transparency, CASE WHEN event_id % 3 <> 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS no_policy, round(l * {twin.SENSITIVITY}::DOUBLE, 12) AS likelihood_impact, 1.0::DOUBLE AS corpus_no_policy FROM r""")
def rk08(spark, sf):
    e = _risks(spark, sf)
    return e.select("event_id", F.round(R.risk(F.col("l"), F.col("sev"), F.lit(1.0)), 12).alias("no_transparency"), F.when(F.col("event_id") % 3 != 0, 0.0).otherwise(1.0).alias("no_policy"), F.round(F.col("l") * R.data_sensitivity(F.col("data_categories")), 12).alias("likelihood_impact"), F.lit(1.0).alias("corpus_no_policy"))


_SHIFTS = [(k, f) for k in ("data", "sent", "why") for f in (0.8, 1.2)]
_C = "greatest(0.0::DOUBLE, least(2.0::DOUBLE, ({})::DOUBLE * CASE WHEN shifted = '{}' THEN factor ELSE 1.0 END))"


@query(
    "rk14_table_shifts",
    f"{EV}, g AS (SELECT unnest([" + ", ".join(f"{{'shifted': '{k}', 'factor': {f}::DOUBLE}}" for k, f in _SHIFTS) + f"""], recursive := true)),
    s AS (SELECT shifted, factor, round(least(1.0::DOUBLE, {_C.format(twin.SENSITIVITY, 'data')} * (0.6::DOUBLE + 0.9::DOUBLE * {_C.format(twin.TRANSMISSION, 'sent')}) * (0.5::DOUBLE + 0.9::DOUBLE * {_C.format(twin.PURPOSE, 'why')}) * ({twin.BASIS})::DOUBLE), 10) AS sev FROM events_in CROSS JOIN g)
    SELECT shifted, factor, count(*) AS n, count(*) FILTER (sev >= 0.5) AS high, round(avg(sev), 6) AS mean FROM s GROUP BY ALL""",
)
def rk14(spark, sf):
    """Severities with each table up or down by a fifth, all shifts in one pass over the events."""
    e = frame(spark, sf, "events").select("data_categories", "actions", "purposes", "recipients", "action_type", F.explode(F.array(*[F.struct(F.lit(k).alias("shifted"), F.lit(f).alias("factor")) for k, f in _SHIFTS])).alias("g")).select("*", "g.*")
    by = lambda k: F.when(F.col("shifted") == k, F.col("factor")).otherwise(1.0)
    s = e.select("shifted", "factor", F.round(R.shifted_severity(*_cols("data_categories", "actions", "purposes", "recipients", "action_type"), by("data"), by("sent"), by("why")), 10).alias("sev"))
    return s.groupBy("shifted", "factor").agg(F.count("*").alias("n"), F.count_if(F.col("sev") >= 0.5).alias("high"), F.round(F.avg("sev"), 6).alias("mean"))


_NER = {"PERSON": "[A-Z][a-z]+ [A-Z][a-z]+", "DATE": "(?:19|20)[0-9][0-9]"}


@query("sn02_first_entities", "SELECT doc_id, category, value FROM (SELECT doc_id, 'Personal' AS category, regexp_extract(text, '[A-Z][a-z]+ [A-Z][a-z]+') AS value FROM documents UNION ALL SELECT doc_id, 'Demographic', regexp_extract(text, '(?:19|20)[0-9][0-9]') FROM documents) WHERE value <> ''")
def sn02(spark, sf):
    """Patterns stand in for a named-entity model, which is injected where there is one."""
    x = table(spark, sf, "documents").select("doc_id", F.explode(X.first_per_category(F.col("text"), _NER, models.ENTITY_CATEGORY)).alias("e"))
    return x.select("doc_id", "e.category", "e.value")


@query(
    "se04_override_merge",
    f"""{EV}, m AS (SELECT event_id, list_distinct(data_categories) AS kw, list_distinct(list_concat(data_categories[1:1], ['Location'])) AS ner, list_filter(list_distinct(data_categories), lambda x: length(x) > 6) AS llm FROM events_in)
    SELECT event_id, unnest(llm) AS category, 'llm' AS method FROM m UNION ALL
    SELECT event_id, unnest(list_filter(kw, lambda x: NOT list_contains(llm, x))), 'keyword' FROM m UNION ALL
    SELECT event_id, unnest(list_filter(ner, lambda x: NOT list_contains(llm, x) AND NOT list_contains(kw, x))), 'ner' FROM m""",
)
def se04(spark, sf):
    of = lambda a, m: F.transform(a, lambda c: F.struct(c.alias("category"), F.lit(0.5).alias("confidence"), F.lit(m).alias("method")))
    d = F.array_distinct("data_categories")
    ner = F.array_distinct(F.concat(F.slice("data_categories", 1, 1), F.array(F.lit("Location"))))
    all_ = models.merged(of(d, "keyword"), of(ner, "ner"), of(F.filter(d, lambda x: F.length(x) > 6), "llm"))
    return frame(spark, sf, "events").select("event_id", F.explode(all_).alias("c")).select("event_id", "c.category", "c.method")


@query("an13_fields", "SELECT conv_id, turn, field, trim(value) AS value FROM (SELECT conv_id, turn, unnest(['role', 'text', 'note']) AS field, unnest([role, text, '  ']) AS value FROM conversations) WHERE trim(coalesce(value, '')) <> ''")
def an13(spark, sf):
    """A record's fields one by one, each with its name as context; fields without text are passed by."""
    m = F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"), F.lit("note"), F.lit("  "))
    x = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(m).alias("field", "value"))
    return x.where(F.trim(F.coalesce("value", F.lit(""))) != "").select("conv_id", "turn", "field", F.trim("value").alias("value"))


@query(
    "an18_verification_ablation",
    f"""{O}, c AS (SELECT grp, CASE WHEN x >= 0.6 AND y >= 0.6 THEN 'kept' WHEN x >= 0.6 THEN 'avoided' WHEN y >= 0.6 THEN 'added' ELSE 'none' END AS class, CASE WHEN gold > pred THEN 'up' WHEN gold < pred THEN 'down' ELSE 'same' END AS level FROM outcomes_in)
    SELECT grp, class, level, count(*) AS n FROM c GROUP BY ALL""",
)
def an18(spark, sf):
    """What verification changes: raw confidence x against verified y at 0.6, level with against without."""
    x, y = F.col("x") >= 0.6, F.col("y") >= 0.6
    kind = F.when(x & y, "kept").when(x, "avoided").when(y, "added").otherwise("none")
    level = F.when(F.col("gold") > F.col("pred"), "up").when(F.col("gold") < F.col("pred"), "down").otherwise("same")
    return frame(spark, sf, "outcomes").groupBy("grp", kind.alias("class"), level.alias("level")).agg(F.count("*").alias("n"))


_T = twin.TOKENS


@query("lm05_shared_tokens", f"WITH n AS (SELECT conv_id, turn, {_T.format('text')} AS a, {_T.format('lead(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(a), b))::DOUBLE / len(list_distinct(a)) END, 6) AS shared FROM n WHERE b IS NOT NULL")
def lm05(spark, sf):
    c = table(spark, sf, "conversations").withColumn("next", F.lead("text").over(W.Window.partitionBy("conv_id").orderBy("turn")))
    return c.where(F.col("next").isNotNull()).select("conv_id", "turn", F.round(X.shared_of_first(F.col("text"), F.col("next")), 6).alias("shared"))


@query("lm02_prompts", f"""{EV} SELECT event_id, md5('{{"actions": [' || array_to_string(list_transform(list_sort(actions), lambda x: '"' || x || '"'), ', ') || '], "domain": ' || coalesce('"' || domain || '"', 'null') || ', "purposes": [' || array_to_string(list_transform(list_sort(purposes), lambda x: '"' || x || '"'), ', ') || ']}}') AS prompt FROM events_in""")
def lm02(spark, sf):
    """The behaviour as canonical JSON, as it stands in a decision prompt."""
    j = X.canonical_json({"domain": X.json_text(F.col("domain")), "actions": X.json_list(F.col("actions")), "purposes": X.json_list(F.col("purposes"))})
    return frame(spark, sf, "events").select("event_id", F.md5(j).alias("prompt"))


@query("fn_formats_and_dates", "SELECT event_id, printf('%04d', event_id % 10000) AS code, printf('%.3f', (event_id % 1000) / 8) AS amount, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, floor(epoch(ts))::BIGINT AS seconds FROM events")
def fn_formats(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.format_string("%04d", F.col("event_id") % 10000).alias("code"), F.format_string("%.3f", F.col("event_id") % 1000 / 8).alias("amount"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_timestamp("ts").alias("seconds"))


@query("fn_log_gamma", f"{O} SELECT key, round(lgamma(0.5 + x * 10), 6) AS log_gamma FROM outcomes_in")
def fn_log_gamma(spark, sf):
    return frame(spark, sf, "outcomes").select("key", F.round(features.log_gamma(0.5 + F.col("x") * 10), 6).alias("log_gamma"))


def _psi(x: str) -> str:
    return f"((lgamma({x} + 1e-4) - lgamma({x} - 1e-4)) / 2e-4)"


@query(
    "ml06_evidential_loss",
    f"""{O}, a AS (SELECT grp, gold::DOUBLE AS y1, 1.0 - gold AS y0, 1.0 + x * 3 AS a0, 1.0 + y * 3 AS a1 FROM outcomes_in), b AS (SELECT *, a0 + a1 AS s, y0 + (1 - y0) * a0 AS b0, y1 + (1 - y1) * a1 AS b1 FROM a)
    SELECT grp, round(avg(pow(y0 - a0 / s, 2) + pow(y1 - a1 / s, 2) + (a0 * (s - a0) + a1 * (s - a1)) / (s * s * (s + 1)) + 0.5 * (lgamma(b0 + b1) - lgamma(b0) - lgamma(b1) + (b0 - 1) * ({_psi('b0')} - {_psi('(b0 + b1)')}) + (b1 - 1) * ({_psi('b1')} - {_psi('(b0 + b1)')}))), 4) AS loss FROM b GROUP BY 1""",
)
def ml06(spark, sf):
    o = frame(spark, sf, "outcomes")
    return o.groupBy("grp").agg(F.round(F.avg(features.evidential_loss(1.0 + F.col("x") * 3, 1.0 + F.col("y") * 3, F.col("gold"), F.lit(5.0))), 4).alias("loss"))
