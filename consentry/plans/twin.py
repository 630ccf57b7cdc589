"""DuckDB expressions of the risk model, for the SQL twins of the queries. Written apart from the Column functions."""

from __future__ import annotations

from ..functions import tables as T


def case(rows, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v!r}" for c, v in rows) + f" ELSE {otherwise!r} END"


def best(items: str, var: str, expr: str, empty: str, how: str = "list_max") -> str:
    return f"coalesce({how}(list_transform({items}, lambda {var}: {expr})), {empty})"


TRANSMISSION = best("recipients", "r", case([(f"contains(lower(r), '{k}')", v) for k, v in T.TRANSMISSION.items()], 0.7), "CASE WHEN list_has_any(list_transform(actions, lambda a: lower(a)), ['transfer', 'share', 'sell']) THEN 0.75 WHEN list_has_any(list_transform(actions, lambda a: lower(a)), ['collect', 'store', 'process']) THEN 0.35 ELSE 0.5 END")
PURPOSE = best("purposes", "p", case([(f"p = '{k}'", v) for k, v in T.PURPOSE.items()] + [(f"contains(lower(p), '{k.lower()}') OR contains('{k.lower()}', lower(p))", v) for k, v in T.PURPOSE.items()], 0.5), "0.65")
SENSITIVITY = best("data_categories", "c", case([(f"c = '{k}'", v) for k, v in T.SENSITIVITY.items()], 0.3), "0.1")
BASIS = "CASE WHEN lower(action_type) IN ('paste', 'selection', 'input', 'copy') THEN 0.6 WHEN lower(action_type) IN ('xmlhttprequest', 'script', 'fetch') THEN 1.2 ELSE 1.0 END"


def severity(basis: str = BASIS, purpose: str = f"(0.5::DOUBLE + 0.9::DOUBLE * ({PURPOSE})::DOUBLE)") -> str:
    return f"least(1.0::DOUBLE, ({SENSITIVITY})::DOUBLE * (0.6::DOUBLE + 0.9::DOUBLE * ({TRANSMISSION})::DOUBLE) * {purpose} * ({basis})::DOUBLE)"


_RANK = {"critical": 0, "high": 1, "moderate": 2, "low": 3}
TIER = "(CASE least(2, " + best("data_categories", "c", case([(f"c = '{k}'", _RANK[v]) for k, v in T.CATEGORY_TIER.items()], 2), "2", "list_min") + ") WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'moderate' END)"
ALLOW = "(CASE tier " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in T.TIERS.items()) + " END)"
DENY = "(CASE tier " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in T.TIERS.items()) + " END)"
DECISION = f"CASE WHEN risk < {ALLOW} THEN 'allow' WHEN risk < {DENY} THEN 'transform' ELSE 'deny' END"


def found(text: str, terms: dict[str, str]) -> str:
    """Sorted different values whose key the text contains."""
    return "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower({text}), '{k}') THEN '{v}' END" for k, v in terms.items()) + "], lambda x: x IS NOT NULL)))"


FIELDS = ("data_categories", "actions", "purposes", "recipients")
_W = {"data_categories": 0.35, "actions": 0.35, "purposes": 0.2, "recipients": 0.1}
TOKENS = r"list_transform(regexp_extract_all({}, '[A-Za-z0-9_]+'), lambda x: lower(x))"

LATEST = """latest AS (SELECT domain, doc_id AS policy_doc_id, policy_domain FROM (
  SELECT e.domain, d.doc_id, d.domain AS policy_domain, row_number() OVER (PARTITION BY e.domain ORDER BY d.created_at DESC, d.doc_id) AS r
  FROM (SELECT DISTINCT domain FROM events_in WHERE domain <> '') e JOIN docs_in d ON contains(d.domain, e.domain)) WHERE r = 1)"""
CANDIDATES = "cand AS (SELECT e.*, l.policy_doc_id, l.policy_domain, s.id AS s_id, s.snippet AS s_snippet, " + ", ".join(f"s.{f} AS s_{f}" for f in FIELDS) + ", s.legal_basis AS s_legal_basis, s.rights_flag AS s_rights_flag, s.transfer_outside AS s_transfer_outside, s.retention_mode AS s_retention_mode FROM {} e JOIN latest l ON e.domain = l.domain JOIN statements_in s ON s.policy_doc_id = l.policy_doc_id)"


def _overlap(f: str) -> str:
    return f"{_W[f]}::DOUBLE * least(1.0::DOUBLE, len(list_intersect(list_distinct(s_{f}), list_distinct({f})))::DOUBLE / greatest(1, len(list_distinct({f}))))"


STRUCTURED = "greatest(0.0::DOUBLE, least(1.2::DOUBLE, (CASE WHEN contains(domain, policy_domain) THEN 0.1 ELSE 0.0 END)::DOUBLE + " + " + ".join(_overlap(f) for f in FIELDS) + " + (CASE WHEN s_rights_flag THEN 0.05 ELSE 0.0 END)::DOUBLE + (CASE WHEN s_transfer_outside THEN 0.03 ELSE 0.0 END)::DOUBLE + (CASE WHEN s_retention_mode <> '' THEN 0.02 ELSE 0.0 END)::DOUBLE))"
_TEXT = "concat_ws(' ', snippet, array_to_string(data_categories, ' '), array_to_string(actions, ' '), array_to_string(purposes, ' '), array_to_string(recipients, ' '), legal_basis)"
_QUERY = "concat_ws(' ', platform, domain, app_id, action_type, array_to_string(data_categories, ' '), array_to_string(actions, ' '), array_to_string(purposes, ' '), array_to_string(recipients, ' '))"
BM25 = f"""st AS (SELECT policy_doc_id, id, {TOKENS.format(_TEXT)} AS t FROM statements_in),
per_doc AS (SELECT policy_doc_id, count(*) AS n, avg(len(t)) AS avgdl FROM st GROUP BY ALL),
tf AS (SELECT policy_doc_id, id, dl, token, count(*) AS tf FROM (SELECT policy_doc_id, id, len(t) AS dl, unnest(t) AS token FROM st) GROUP BY ALL),
dfs AS (SELECT policy_doc_id, token, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT tf.policy_doc_id, tf.id, tf.token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / greatest(1e-9, tf + 1.5 * (0.25 + 0.75 * dl / greatest(1.0, avgdl))) AS weight
  FROM tf JOIN dfs USING (policy_doc_id, token) JOIN per_doc USING (policy_doc_id))"""
KEYWORD = f"""kq AS (SELECT event_id, policy_doc_id, unnest({TOKENS.format(_QUERY)}) AS token FROM (SELECT DISTINCT event_id, policy_doc_id, platform, domain, app_id, action_type, data_categories, actions, purposes, recipients FROM cand)),
kw AS (SELECT event_id, id AS s_id, sum(weight) AS keyword FROM kq JOIN bm USING (policy_doc_id, token) GROUP BY ALL)"""
HYBRID = f"""sc AS (SELECT cand.*, {STRUCTURED} AS structured, coalesce(keyword, 0.0) AS keyword FROM cand LEFT JOIN kw USING (event_id, s_id)),
hy AS (SELECT *, round(0.6::DOUBLE * structured / (CASE WHEN max(structured) OVER w = 0 THEN 1.0 ELSE max(structured) OVER w END) + (1::DOUBLE - 0.6::DOUBLE) * keyword / (CASE WHEN max(keyword) OVER w = 0 THEN 1.0 ELSE max(keyword) OVER w END), 9) AS score FROM sc WINDOW w AS (PARTITION BY event_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, s_id) AS rank FROM hy) WHERE rank <= 8)"""
EVIDENCE = """evd AS (SELECT event_id, count(*) AS n_evidence, bool_or(length(s_snippet) >= 50) AS e1, bool_or(list_has_any(s_data_categories, data_categories)) AS e2, bool_or(list_has_any(s_purposes, purposes)) AS e3,
  bool_or(coalesce(s_legal_basis <> '', false)) AS e4, bool_or(coalesce(s_rights_flag, false)) AS e5, bool_or(coalesce(s_retention_mode <> '', false)) AS e6 FROM top GROUP BY event_id)"""
TRANSPARENCY = "(CASE WHEN n_evidence IS NULL THEN 1.3 ELSE greatest(0.8::DOUBLE, 1.3::DOUBLE" + "".join(f" - (CASE WHEN e{k} THEN {w} ELSE 0 END)::DOUBLE" for k, w in enumerate((0.1, 0.15, 0.1, 0.08, 0.05, 0.02), 1)) + ") END)::DOUBLE"
CAPTURE = "lower(action_type) IN ('paste', 'input', 'selection', 'copy')"
SKIP = f"(NOT {CAPTURE} AND lower(coalesce(data_categories[1], '')) IN ('image', 'stylesheet', 'font', 'media', 'ping', 'websocket', 'other'))"
ENRICHED = f"(CASE WHEN {CAPTURE} AND len({found('masked', T.FIELD_PATTERNS)}) > 0 THEN list_sort(list_distinct(list_concat(data_categories, {found('masked', T.FIELD_PATTERNS)}))) ELSE data_categories END)"
