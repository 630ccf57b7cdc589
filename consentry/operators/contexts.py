"""Studies of one behaviour in several contexts, each with a preset of what the policy shows, and risks of real policy texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk as R

#: Likelihood of harm in these studies.
LIKELIHOOD = 0.7


@dataclass(frozen=True)
class Evidence:
    """One piece of evidence: a snippet, and what it says."""

    snippet: str = ""
    data_categories: tuple[str, ...] = ()
    purposes: tuple[str, ...] = ()
    legal: bool = False
    rights: bool = False
    retention: bool = False


@dataclass(frozen=True)
class Context:
    name: str
    recipient: str
    purpose: str
    action: str
    action_type: str
    evidence: Evidence | None  # none: no policy is found


# The contexts of the two studies and what their policies show (snippets count by their length of 50 characters).
_FULL = Evidence("the purpose, the time that data is kept, transfers, categories, legal basis and how to have data deleted", ("Email", "Content"), ("Functionality",), True, True, True)
_PARTIAL = Evidence("data is collected for analytics, which includes page views and how long a session is", ("Email", "Content"), ("Analytics",))
_VAGUE = Evidence("used as needed")
CONTROL = (
    Context("C_low", "first_party", "Functionality", "Collect", "paste", _FULL),
    Context("C_med", "service_provider", "Analytics", "Collect", "default", _PARTIAL),
    Context("C_high", "advertising", "Profiling", "Share", "script", _VAGUE),
    Context("C_extreme", "data_broker", "Advertising", "Share", "script", None),
)
_MILD = "information about use, collected to make the service more personal"
BAND = (
    Context("T_mild", "first_party", "Personalization", "Collect", "default", Evidence(_MILD, ("Email",), ("Personalization",))),
    Context("T_moderate", "service_provider", "Personalization", "Collect", "default", Evidence(_MILD[:47], ("Email",), ("Personalization",))),
    Context("T_strong", "service_provider", "Marketing", "Collect", "default", Evidence("partners deliver promotions, and insights are shared with networks", ("Email",), ("Marketing",))),
    Context("T_near_deny", "advertising", "Marketing", "Share", "default", Evidence("contact details are shared for targeted advertising, and kept for months", ("Email",), ("Marketing",), retention=True)),
)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def in_contexts(rows: DataFrame, contexts: tuple[Context, ...]) -> DataFrame:
    """rows, which have data_categories, once per context, with context, risk (12 digits), tier, decision, level and banded_level."""
    def one(c: Context) -> Column:
        e = c.evidence or Evidence()
        said = {"recipients": _strings([c.recipient]), "purposes": _strings([c.purpose]), "actions": _strings([c.action]), "shown": _strings(e.data_categories), "why": _strings(e.purposes)}
        told = {"name": c.name, "action_type": c.action_type, "n": int(c.evidence is not None), "long": len(e.snippet) >= 50, "legal": e.legal, "rights": e.rights, "retention": e.retention}
        return F.struct(*(v.alias(k) for k, v in said.items()), *(F.lit(v).alias(k) for k, v in told.items()))

    each = F.array(*map(one, contexts))
    x = rows.withColumn("_c", F.explode(each))
    c, own = (lambda f: F.col(f"_c.{f}")), F.coalesce("data_categories", F.array().cast("array<string>"))
    t = R.transparency(c("n"), c("long"), F.arrays_overlap(c("shown"), own), F.arrays_overlap(c("why"), c("purposes")), c("legal"), c("rights"), c("retention"))
    s = R.severity(F.col("data_categories"), c("actions"), c("purposes"), c("recipients"), c("action_type"))
    x = x.withColumns({"context": c("name"), "risk": F.round(R.risk(F.lit(LIKELIHOOD), s, t), 12), "tier": R.decision_tier(F.col("data_categories"))})
    return x.withColumns({"decision": R.decision(F.col("risk"), F.col("tier")), "level": R.level(F.col("risk")), "banded_level": R.banded_level(F.col("risk"), F.col("tier"))}).drop("_c")


def policy_risk(rows: DataFrame, text: str, limit: int = 1200) -> DataFrame:
    """rows (behaviours with their policy's text) with risk and decision: the text is one piece of evidence that names the
    behaviour's own categories and purposes, and tells a legal basis if it contains "consent". Rights and retention
    never count here: they are not read from such evidence. A null text is an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    shown = R.transparency(F.lit(1), F.length(F.left(t, F.lit(limit))) >= 50, some("data_categories"), some("purposes"), F.contains(F.lower(t), F.lit("consent")), F.lit(False), F.lit(False))
    s = R.severity(*(F.col(c) for c in ("data_categories", "actions", "purposes", "recipients", "action_type")))
    x = rows.withColumn("risk", F.round(R.risk(F.lit(LIKELIHOOD), s, shown), 12))
    return x.withColumn("decision", R.decision(F.col("risk"), R.decision_tier(F.col("data_categories"))))
