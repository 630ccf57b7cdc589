"""Policy-domain inputs derived from the driver's tables, in two SQL dialects from one definition.

The tables have no policies or behaviours of their own; these derivations give every
operator whole tables with all the cases that it must tell apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T

CATEGORIES = [*T.SENSITIVITY, "Files", "Cookies"]
ACTIONS = ["Collect", "Share", "Use", "store", "Transfer", "sell", "Process"]
PURPOSES = ["functionality", "Security", "ads_first_party", "Advertising", "marketing", "profiling", "Legal", "research", "analytics", "Unknown", "downloads", "Personalization"]
RECIPIENTS = ["first_party", "third_party_analytics", "Advertising_Network", "acme", "data_broker", "Service_Provider"]
MASKED = ["Password: [t:1]", "email and street", "nothing here", "GPS latitude", "bank token"]


class Dialect:
    """Spells what differs between Spark SQL and DuckDB."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def strings(self, values) -> str:
        return self.array(*(f"'{v}'" for v in values))

    def none(self) -> str:
        return "cast(array() as array<string>)" if self.spark else "[]::VARCHAR[]"

    def pick(self, values, index: str) -> str:
        return f"element_at({self.strings(values)}, cast({index} as int) + 1)" if self.spark else f"({self.strings(values)})[{index} + 1]"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"


def _lists(d: Dialect, i: str) -> str:
    """The four array columns of row number i."""
    return f"""
      CASE WHEN {i} % 11 = 0 THEN {d.none()} WHEN {i} % 17 = 0 THEN {d.strings(["image"])} WHEN {i} % 3 = 0 THEN {d.array(d.pick(CATEGORIES, f"{i} % 23"))}
           ELSE {d.array(d.pick(CATEGORIES, f"{i} % 23"), d.pick(CATEGORIES, f"{d.div(i, 7)} % 23"))} END AS data_categories,
      CASE WHEN {i} % 10 = 0 THEN {d.none()} ELSE {d.array(d.pick(ACTIONS, f"{i} % 7"), d.pick(ACTIONS, f"{d.div(i, 5)} % 7"))} END AS actions,
      CASE WHEN {i} % 6 = 0 THEN {d.none()} ELSE {d.array(d.pick(PURPOSES, f"{i} % 12"))} END AS purposes,
      CASE WHEN {i} % 4 = 0 THEN {d.array(d.pick(RECIPIENTS, f"{d.div(i, 4)} % 6"))} ELSE {d.none()} END AS recipients"""


HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


def _events(d: Dialect) -> str:
    return f"""SELECT event_id, user_id, ts, value, 'web' AS platform, concat('app', event_id % 3) AS app_id,
      CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN regexp_replace({HOST}, '^(www|m)[.]', '') ELSE {HOST} END AS domain,
      CASE event_type WHEN 'click' THEN 'xmlhttprequest' WHEN 'view' THEN 'fetch' WHEN 'purchase' THEN 'Paste' WHEN 'signup' THEN 'input' ELSE event_type END AS action_type,
      CASE WHEN event_id % 2 = 0 THEN {d.pick(MASKED, f"{d.div('event_id', 2)} % 5")} ELSE '' END AS masked, {_lists(d, "event_id")}
    FROM (SELECT *, event_id % (SELECT count(*) FROM pg_raw) AS on_page FROM ev_raw) AS e LEFT JOIN pg_raw ON page_id = on_page"""


def _statements(d: Dialect) -> str:
    ids = "SELECT page_id, html, k, page_id * 3 + k AS id FROM pg_raw " + ("LATERAL VIEW explode(array(0, 1, 2)) v AS k" if d.spark else "CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)")
    # a page's three statements are its whole text: a short beginning and the two halves of the rest
    first = "(20 + (page_id * 3 % 5) * 15)"
    half = d.div(f"greatest(0, length(html) - {first})", 2)
    snippet = f"CASE k WHEN 0 THEN substring(html, 1, cast({first} AS int)) WHEN 1 THEN substring(html, cast(1 + {first} AS int), cast({half} AS int)) ELSE substring(html, cast(1 + {first} + {half} AS int)) END"
    return f"""SELECT id, cast(page_id AS {"string" if d.spark else "VARCHAR"}) AS policy_doc_id, {snippet} AS snippet, {_lists(d, "id")},
      CASE WHEN id % 3 = 0 THEN 'consent' END AS legal_basis, CASE WHEN id % 8 = 0 THEN NULL ELSE id % 4 = 0 END AS rights_flag, id % 7 = 0 AS transfer_outside, CASE WHEN id % 5 = 0 THEN 'period' END AS retention_mode
    FROM ({ids}) AS x"""


def _docs(d: Dialect) -> str:
    return f"SELECT cast(page_id AS {'string' if d.spark else 'VARCHAR'}) AS doc_id, {HOST} AS domain, page_id * 37 % 101 AS created_at FROM pg_raw"


def _gazetteer(d: Dialect) -> str:
    """Names to recognise: words of the benchmark's texts, one label a place."""
    at = lambda k: f"get(split(text, ' '), {k})" if d.spark else f"(string_split(text, ' '))[{k + 1}]"
    places = {"PERSON": f"{at(0)} || ' ' || {at(1)}", "GPE": at(3), "FAC": f"{at(5)} || ' ' || {at(6)}", "ORG": at(7), "LOC": at(9), "NORP": at(12), "DATE": at(14), "MONEY": f"{at(16)} || ' ' || {at(17)} || ' ' || {at(18)}"}
    return " UNION ALL ".join(f"SELECT {x} AS phrase, '{label}' AS label FROM bm_raw WHERE length({x}) >= 5" for label, x in places.items())


def _prefs(d: Dialect) -> str:
    return "SELECT user_id * 2 + v AS id, user_id, 'consent' AS namespace, 'ads' AS key, CASE WHEN v = 1 AND user_id % 5 = 0 THEN ' Opt-Out ' ELSE 'opt-in' END AS value, v AS updated_at FROM (SELECT DISTINCT user_id FROM ev_raw) AS u " + ("LATERAL VIEW explode(array(0, 1)) x AS v" if d.spark else "CROSS JOIN (SELECT unnest([0, 1]) AS v)")


#: Outcomes to evaluate: one row per order line.
_OUTCOMES = """SELECT l_orderkey * 10 + l_linenumber AS key, l_orderkey AS unit, l_returnflag AS grp, l_quantity / 50 AS x, l_discount * 10 AS y, l_tax * 10 AS z,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS gold, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS pred,
  CASE l_partkey % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'transform' ELSE 'deny' END AS gold_label, CASE (l_partkey + l_suppkey % 2) % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'transform' ELSE 'deny' END AS pred_label
FROM line_raw"""
#: Groups to draw from again: suppliers of a nation, numbered from 0.
_DRAWS = "SELECT s_nationkey AS grp, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, s_acctbal / 1000 AS v, (s_acctbal - 4000) / 1000 AS d FROM supp_raw"

PARTS = {"events": _events, "statements": _statements, "docs": _docs, "prefs": _prefs, "gazetteer": _gazetteer, "outcomes": lambda d: _OUTCOMES, "draws": lambda d: _DRAWS}
RAW = {"ev_raw": "events", "pg_raw": "pages", "line_raw": "lineitem", "supp_raw": "supplier", "bm_raw": "benchmark"}


def frame(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """A derived input as a DataFrame."""
    sql = PARTS[part](Dialect(True))
    used = {k: spark.read.parquet(f"{sf_dir}/{v}.parquet") for k, v in RAW.items() if k in sql}
    for k in used:
        sql = sql.replace(k, "{" + k + "}")
    return spark.sql(sql, **used)


def ctes(*parts: str) -> str:
    """The derived inputs as the head of a DuckDB query."""
    raw = [f"{k} AS (SELECT * FROM {v})" for k, v in RAW.items()]
    return "WITH " + ",\n".join([*raw, *(f"{p}_in AS ({PARTS[p](Dialect(False))})" for p in parts)]) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unrolled(values) -> F.Column:
    return F.array(*map(F.lit, values))
