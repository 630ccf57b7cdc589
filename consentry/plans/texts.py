"""Queries of texts: HTML, sensitive phrases, recognisers, anonymisation, corpus readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import risk as R
from ..functions import tables as T
from ..functions import text as X
from ..operators import anonymize, intervals
from ..sources import readers
from . import text_twin as TT
from . import twin
from .inputs import ctes, frame, table

_TOKENS = twin.TOKENS.format("coalesce(text, '')")


@query("sc18_policy_html", r"SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 3500) AS text FROM pages")
def sc18(spark, sf):
    return readers.policies_html(table(spark, sf, "pages"))


@query("fn_tokens", f"SELECT doc_id, len({_TOKENS}) AS n, len(list_distinct({_TOKENS})) AS n_distinct, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def fn_tokens(spark, sf):
    t = X.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("digest"))


def _phrase_hit(phrases: list[str]) -> str:
    return "list_filter([" + ", ".join("'" + p.replace("'", "''") + "'" for p in sorted(phrases, key=lambda p: -len(p))) + "], lambda p: contains(lower(text), p))[1]"


_HITS = " UNION ALL ".join(f"SELECT conv_id, turn, '{c}' AS category, {_phrase_hit(p)} AS matched_phrase FROM conversations" for c, p in T.PHRASES.items())


@query("sn01_keyword_categories", f"SELECT conv_id, turn, category, matched_phrase FROM ({_HITS}) WHERE matched_phrase IS NOT NULL")
def sn01(spark, sf):
    x = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.sensitive_phrases(F.col("text"))).alias("c"))
    return x.select("conv_id", "turn", "c.category", "c.matched_phrase")


@query("an01_email_card_entities", rf"""SELECT doc_id, len(regexp_extract_all(text, '{T.ENTITIES["EMAIL"]}')) AS n_email, len(regexp_extract_all(text, '{T.ENTITIES["CREDIT_CARD"]}')) AS n_card, array_to_string(list_transform(regexp_extract_all(text, '{T.ENTITIES["EMAIL"]}'), lambda x: x), ',') AS emails FROM documents""")
def an01(spark, sf):
    e = X.entities(F.col("text"))
    of = lambda k: F.filter(e, lambda x: x["type"] == k)
    return table(spark, sf, "documents").select("doc_id", F.size(of("EMAIL")).cast("long").alias("n_email"), F.size(of("CREDIT_CARD")).cast("long").alias("n_card"), F.array_join(F.transform(of("EMAIL"), lambda x: x["value"]), ",").alias("emails"))


@query("an02_offsets_hold", "SELECT doc_id, true AS ok FROM documents")
def an02(spark, sf):
    """Whether each entity's offsets cut its value out of the text."""
    ok = F.forall(X.entities(F.col("text")), lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]) == e["value"])
    return table(spark, sf, "documents").select("doc_id", ok.alias("ok"))


_LEVELS = f"WITH {TT.PATTERNS}, lv AS (SELECT doc_id, len(rx) AS n_entities, {TT.levels('rx')} FROM rx)"


@query("an03_an05_levels", f"{_LEVELS} SELECT doc_id, n_entities, md5(l1) AS digest1, md5(l2) AS digest2, md5(l3) AS digest3 FROM lv")
def an03(spark, sf):
    x = anonymize.levels(table(spark, sf, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.size("entities").alias("n_entities"), *(F.md5(f"l{k}").alias(f"digest{k}") for k in (1, 2, 3)))


_UNSAFE = "strpos({t}, '@') > 0 OR strpos({t}, '****') > 0"


@query("an12_adaptive", f"{_LEVELS}, {TT.adaptive('lv', '(doc_id % 10 / 10.0)', _UNSAFE)} SELECT doc_id, initial_level, final_level, rounds, upgraded, md5(anonymized) AS digest FROM ad")
def an12(spark, sf):
    """Escalates while an e-mail's domain or the last digits of a number can still be read."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    unsafe = lambda t: F.contains(t, F.lit("@")) | F.contains(t, F.lit("****"))
    x = anonymize.adaptive(d, R.level(F.col("doc_id") % 10 / F.lit(10.0)), unsafe)
    return x.select("doc_id", "initial_level", "final_level", "rounds", "upgraded", F.md5("anonymized").alias("digest"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ',\s*,', ',', 'g'), '\s{2,}', ' ', 'g'), ',\s*$', '', 'g'), '^\s*,', '', 'g'), '(in|at|to|from|near|around)\s*,\s*', '\1 ', 'g'), '^\s+|\s+$', '', 'g')"""


@query("an07_cleanup", f"SELECT conv_id, turn, md5({_CLEAN}) AS digest FROM conversations")
def an07(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.cleanup(F.col("text"))).alias("digest"))


_A, _B = (twin.TOKENS.format(x) for x in ("a.text", "b.text"))


@query("an14_turn_utility", f"SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat({_A}, {_B}))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({_A}), list_distinct({_B})))::DOUBLE / len(list_distinct(list_concat({_A}, {_B}))) END, 6) AS jaccard FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def an14(spark, sf):
    c = table(spark, sf, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("ta")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tb"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(X.tokens(F.col("ta")), X.tokens(F.col("tb"))), 6).alias("jaccard"))


_FIELDS = "['pathetic', 'scum', 'the', 'Zz Top']"


@query("an15_retained_fields", f"SELECT doc_id, round(len(list_filter({_FIELDS}, lambda x: contains(lower(text), lower(x)))) / 4.0, 6)::DOUBLE AS retained FROM documents")
def an15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(X.retained(F.col("text"), F.array(*map(F.lit, ("pathetic", "scum", "the", "Zz Top")))), 6).alias("retained"))


@query("an17_outcomes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.3 THEN 'OVER_ANON' WHEN l_quantity / 50 < 0.5 THEN 'PII_RETAINED' WHEN l_linenumber >= 4 AND l_suppkey % 5 >= 3 THEN 'UPGRADE_CASCADE' WHEN l_quantity / 50 >= 0.8 AND l_discount * 10 >= 0.5 THEN 'CLEAN' ELSE 'PARTIAL' END AS outcome FROM lineitem")
def an17(spark, sf):
    o = anonymize.outcome(F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_linenumber"), F.col("l_suppkey") % 5, F.lit(None).cast("string"), F.col("l_returnflag"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", o.alias("outcome"))


@query("ml08_text_features", f"SELECT doc_id, array_to_string({twin.found('text', T.TEXT_DATA)}, ',') AS data, array_to_string({twin.found('text', T.TEXT_ACTION)}, ',') AS actions, array_to_string({twin.found('text', T.TEXT_PURPOSE)}, ',') AS purposes FROM documents")
def ml08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *(F.array_join(X.found_terms(F.col("text"), t), ",").alias(n) for n, t in (("data", T.TEXT_DATA), ("actions", T.TEXT_ACTION), ("purposes", T.TEXT_PURPOSE))))


_D, _A = "list_distinct(list_concat(acc.d, x.d))", "list_distinct(list_concat(acc.a, x.a))"
_ITEMS = "[]::STRUCT(d VARCHAR[], a VARCHAR[])[]"


@query(
    "sc05_accumulated_items",
    f"""{ctes('events')}, e AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN array_to_string(data_categories, ' ') ELSE array_to_string(actions, ' ') END AS text FROM events_in),
    l AS (SELECT user_id, list({{'d': {twin.found('text', T.TEXT_DATA)}, 'a': {twin.found('text', T.TEXT_ACTION)}, 'items': {_ITEMS}}} ORDER BY event_id) AS l FROM e GROUP BY 1),
    f AS (SELECT user_id, list_reduce(l, lambda acc, x: CASE WHEN len({_D}) > 0 AND len({_A}) > 0 THEN {{'d': []::VARCHAR[], 'a': []::VARCHAR[], 'items': list_append(acc.items, {{'d': list_sort({_D}), 'a': list_sort({_A})}})}} ELSE {{'d': {_D}, 'a': {_A}, 'items': acc.items}} END, {{'d': []::VARCHAR[], 'a': []::VARCHAR[], 'items': {_ITEMS}}}).items AS items FROM l)
    SELECT user_id, generate_subscripts(items, 1) - 1 AS item, array_to_string(unnest(items).d, ',') AS data_categories, array_to_string(unnest(items).a, ',') AS actions FROM f""",
)
def sc05(spark, sf):
    """A user's behaviours stand in for a policy's segments: even ones tell categories, odd ones actions."""
    e = frame(spark, sf, "events").withColumn("text", F.when(F.col("event_id") % 2 == 0, F.array_join("data_categories", " ")).otherwise(F.array_join("actions", " ")))
    x = readers.accumulated(e, "user_id", "event_id", "text")
    return x.select("user_id", "item", F.array_join("data_categories", ",").alias("data_categories"), F.array_join("actions", ",").alias("actions"))


@query("sc09_paragraphs", "WITH p AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS t, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) - 1 AS paragraph FROM documents) SELECT doc_id, paragraph, length(t) AS n FROM p WHERE length(trim(t)) > 50")
def sc09(spark, sf):
    """Lines stand in for paragraphs: the documents have no blank lines of their own."""
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return readers.paragraphs(d, "doc_id", "text").select("doc_id", "paragraph", F.length("text").alias("n"))


_TYPES = {"EMAIL": "DIRECT", "PHONE": "QUASI", "CREDIT_CARD": "NO_MASK", "API_KEY": "OTHER"}
_PARTS = r"regexp_split_to_array(text, '\n\s*\n')"
_SEPARATORS = r"regexp_extract_all(text, '\n\s*\n')"
_LENGTHS = "coalesce(list_sum(list_transform({}[1:i - 1], lambda z: length(z))), 0)"


@query(
    "sc16_contained_entities",
    rf"""WITH {TT.patterns(text="replace(coalesce(text, ''), chr(10), chr(10) || chr(10))")},
    en AS (SELECT doc_id, unnest(rx) AS x FROM rx),
    sp AS (SELECT doc_id, {_PARTS} AS parts, {_SEPARATORS} AS seps FROM rx),
    pa AS (SELECT doc_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: {{'s': {_LENGTHS.format('parts')} + {_LENGTHS.format('seps')}, 't': parts[i]}})) AS p FROM sp),
    pn AS (SELECT doc_id, p.s AS start, p.s + length(p.t) AS stop, trim(p.t, E' \t\n\r\f\v') AS text FROM pa),
    pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS paragraph FROM pn WHERE length(text) >= 30),
    met AS (SELECT doc_id, paragraph, text, x.t AS kind, x.s AS s, x.e AS e, x.v AS v FROM pk JOIN en USING (doc_id) WHERE x.s >= start AND x.e <= stop)
    SELECT doc_id, paragraph, md5(left(any_value(text), 600)) AS digest, string_agg(DISTINCT kind, '|' ORDER BY kind) AS category,
      max(CASE kind WHEN 'EMAIL' THEN 0.85 WHEN 'PHONE' THEN 0.65 WHEN 'CREDIT_CARD' THEN 0.45 ELSE 0.5 END)::DOUBLE AS risk_score, string_agg(v, '|' ORDER BY s, e, v) AS fields FROM met GROUP BY 1, 2""",
)
def sc16(spark, sf):
    """Paragraphs (lines stand in for them) with the identifiers that they hold whole; the kind of identifier tells its type."""
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    kind = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    e = d.select("doc_id", F.explode(X.entities(F.col("text"))).alias("e")).select("doc_id", "e.start", "e.end", F.col("e.value").alias("span_text"), F.col("e.type").alias("entity_type"), kind[F.col("e.type")].alias("identifier_type"))
    x = intervals.annotated_paragraphs(d, e, "doc_id", "text")
    return x.select("doc_id", "paragraph", F.md5("text").alias("digest"), "category", "risk_score", F.array_join("sensitive_fields", "|").alias("fields"))


@query("sm01_hash_sample", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def sm01(spark, sf):
    """A sampling operator: its limit is its size."""
    return readers.first_by_hash(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@query("pf09_truncated", "SELECT doc_id, left(text, 256) AS raw_text FROM documents")
def pf09(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(256)).alias("raw_text"))


@query("an08_lexical_verifier", "WITH t AS (SELECT a.conv_id, a.turn, lower(trim(b.text)) AS g, lower(a.text) AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, contains(o, g) OR list_has_any(list_filter(regexp_split_to_array(g, '\\s+'), lambda w: length(w) > 2), list_filter(regexp_split_to_array(o, '\\s+'), lambda w: length(w) > 2)) AS verified FROM t")
def an08(spark, sf):
    c = table(spark, sf, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("ta")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("guess"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", X.lexical_verified(F.col("guess"), F.col("ta")).alias("verified"))


@query("an09_semantic_verifier", "SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.25 AS verified FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def an09(spark, sf):
    e = table(spark, sf, "embeddings")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    p = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return p.select("vec_id", (dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b"))) >= 0.25).alias("verified"))
