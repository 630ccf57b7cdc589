"""Risk, decision and level formulas as Column expressions; all stay in generated code.

Null arrays count as empty. Behaviour columns are given as Columns, so the same
functions serve batch and streaming frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def _items(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def _case(x: Column, rows, otherwise) -> Column:
    """First row (test, value) whose test holds."""
    out = None
    for test, value in rows:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def transmission(recipients: Column, actions: Column) -> Column:
    """Greatest risk over the recipients; without any, by what the actions do."""
    one = lambda r: _case(r, [(F.contains(F.lower(r), F.lit(k)), v) for k, v in T.TRANSMISSION.items()], 0.7)
    acts = F.transform(_items(actions), F.lower)
    by_action = F.when(F.arrays_overlap(acts, F.array(*map(F.lit, ("transfer", "share", "sell")))), 0.75).when(F.arrays_overlap(acts, F.array(*map(F.lit, ("collect", "store", "process")))), 0.35).otherwise(0.5)
    return F.coalesce(F.array_max(F.transform(_items(recipients), one)), by_action)


def purpose(purposes: Column) -> Column:
    """Greatest risk over the purposes; 0.65 without any."""

    def one(p: Column) -> Column:
        exact = [(p == k, v) for k, v in T.PURPOSE.items()]
        near = [(F.contains(F.lower(p), F.lit(k.lower())) | F.contains(F.lit(k.lower()), F.lower(p)), v) for k, v in T.PURPOSE.items()]
        return _case(p, exact + near, 0.5)

    return F.coalesce(F.array_max(F.transform(_items(purposes), one)), F.lit(0.65))


def data_sensitivity(categories: Column) -> Column:
    """Greatest sensitivity over the categories: 0.3 for an unknown one, 0.1 without any."""
    one = lambda c: _case(c, [(c == k, v) for k, v in T.SENSITIVITY.items()], 0.3)
    return F.coalesce(F.array_max(F.transform(_items(categories), one)), F.lit(0.1))


def basis(action_type: Column) -> Column:
    a = F.lower(F.coalesce(action_type, F.lit("")))
    return F.when(a.isin(*T.CAPTURE_ACTIONS), 0.6).when(a.isin("xmlhttprequest", "script", "fetch"), 1.2).otherwise(1.0)


def severity(categories, actions, purposes, recipients, action_type, use_basis: bool = True, use_purpose: bool = True) -> Column:
    p = F.lit(0.5) + 0.9 * purpose(purposes) if use_purpose else F.lit(1.0)
    m = basis(action_type) if use_basis else F.lit(1.0)
    return F.least(F.lit(1.0), data_sensitivity(categories) * (F.lit(0.6) + 0.9 * transmission(recipients, actions)) * p * m)


def transparency(n_evidence, long_snippet, same_category, same_purpose, legal, rights, retention) -> Column:
    """1.3 without evidence; signals found in any evidence lower it, not below 0.8."""
    signals = ((long_snippet, 0.10), (same_category, 0.15), (same_purpose, 0.10), (legal, 0.08), (rights, 0.05), (retention, 0.02))
    less = reduce(lambda a, b: a - b, [F.when(F.coalesce(s, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0)) for s, w in signals], F.lit(1.3))
    return F.when(F.coalesce(n_evidence, F.lit(0)) == 0, F.lit(1.3)).otherwise(F.greatest(F.lit(0.8), less))


def risk(likelihood, severity_, transparency_) -> Column:
    return F.least(F.lit(1.0), likelihood * severity_ * transparency_)


def _tier_rank(categories: Column) -> Column:
    order = {"critical": 0, "high": 1, "moderate": 2, "low": 3}
    one = lambda c: _case(c, [(c == k, order[v]) for k, v in T.CATEGORY_TIER.items()], 2)
    return F.array_min(F.transform(_items(categories), one))


def decision_tier(categories: Column) -> Column:
    """The most sensitive tier of the categories, at least moderate: low cannot be reached here."""
    r = F.least(F.coalesce(_tier_rank(categories), F.lit(2)), F.lit(2))
    return F.when(r == 0, "critical").when(r == 1, "high").otherwise("moderate")


def band_tier(categories: Column) -> Column:
    """The tier of the most sensitive category by score; low is reached by it."""
    s = F.array_max(F.transform(_items(categories), lambda c: F.struct(_case(c, [(c == k, v) for k, v in T.SENSITIVITY.items()], 0.3).alias("s"), _case(c, [(c == k, v) for k, v in T.CATEGORY_TIER.items()], "moderate").alias("t"))))
    return F.coalesce(s["t"], F.lit("moderate"))


def _threshold(tier: Column, k: int) -> Column:
    return _case(tier, [(tier == t, v[k]) for t, v in T.TIERS.items()], T.TIERS["moderate"][k])


def decision(risk_: Column, tier: Column) -> Column:
    return F.when(risk_ < _threshold(tier, 0), "allow").when(risk_ < _threshold(tier, 1), "transform").otherwise("deny")


def level(risk_: Column) -> Column:
    return F.when(risk_ < 0.5, 1).when(risk_ < 0.7, 2).when(risk_ < 0.85, 3).otherwise(4)


def banded_level(risk_: Column, tier: Column) -> Column:
    """Quarter of the transform band that the risk is in; 1 below the band, 4 from its end."""
    a, d = _threshold(tier, 0), _threshold(tier, 1)
    z = (risk_ - a) / (d - a)
    return F.when(risk_ < a, 1).when(risk_ >= d, 4).when(z < 0.25, 1).when(z < 0.5, 2).when(z < 0.75, 3).otherwise(4)


def nist_5x5(likelihood: Column, impact: Column) -> Column:
    b = lambda x: F.when(x < 0.2, 1).when(x < 0.4, 2).when(x < 0.6, 3).when(x < 0.8, 4).otherwise(5)
    return b(likelihood) * b(impact) / F.lit(25.0)


def iso(likelihood: Column, impact: Column, has_policy: Column, snippet_length: Column) -> Column:
    v = F.when(~has_policy, 1.0).when(snippet_length < 50, 0.8).when(snippet_length < 150, 0.5).otherwise(0.2)
    return 0.4 * likelihood + 0.3 * v + 0.3 * impact


def fair(likelihood: Column, impact: Column, actions: Column, purposes: Column) -> Column:
    l = F.least(F.lit(1.0), likelihood * F.when(F.arrays_overlap(_items(actions), F.array(F.lit("Share"), F.lit("Transfer"))), 1.3).otherwise(1.0))
    m = F.least(F.lit(1.0), impact * F.when(F.arrays_overlap(_items(purposes), F.array(F.lit("Advertising"), F.lit("Marketing"), F.lit("Unknown"))), 1.2).otherwise(1.0))
    return l * m


def legacy(likelihood: Column, severity_: Column, penalty: Column, alpha: float) -> Column:
    """The first version of the formula: likelihood * severity * (1 + alpha * penalty)."""
    return F.least(F.lit(1.0), likelihood * severity_ * (1 + F.lit(alpha) * penalty))


def corpus_truth(base: Column, hardness: Column) -> tuple[Column, Column]:
    """Risk and expected decision of a corpus sample of this base sensitivity and hardness (1 to 5)."""
    r = F.least(F.lit(1.0), base * (1 + 0.15 * (5 - hardness)))
    return r, F.when(r < 0.3, "allow").when(r < 0.7, "transform").otherwise("deny")


def spr(likelihood: Column, severity_: Column, actions: Column, purposes: Column, has_policy: Column) -> Column:
    """A weighted sum of likelihood, severity, sharing, purpose and the lack of a policy."""
    shares = F.arrays_overlap(_items(actions), F.array(F.lit("Share"), F.lit("Transfer")))
    sells = F.arrays_overlap(_items(purposes), F.array(F.lit("Advertising"), F.lit("Marketing"), F.lit("Unknown")))
    one = lambda x: F.when(F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0)
    return 0.30 * likelihood + 0.25 * severity_ + 0.15 * one(shares) + 0.10 * one(sells) + 0.20 * F.when(has_policy, 0.0).otherwise(0.3)


def shifted_severity(categories, actions, purposes, recipients, action_type, data: Column, sent: Column, why: Column) -> Column:
    """severity() with each table scaled by a factor and kept within 0 to 2."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(2.0), x))
    d, t, p = clamp(data_sensitivity(categories) * data), clamp(transmission(recipients, actions) * sent), clamp(purpose(purposes) * why)
    return F.least(F.lit(1.0), d * (F.lit(0.6) + 0.9 * t) * (F.lit(0.5) + 0.9 * p) * basis(action_type))
