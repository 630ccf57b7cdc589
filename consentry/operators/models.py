"""Pluggable recognisers, encoders and language models, and what is done with their answers.

A client is any object whose method the worker can call; it is made once per
worker by a factory and must not raise. The parsing and folding of answers are
Column expressions. Without a client the operators fall back to rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X

#: What a model is asked to return.
DECISION = "decision string, risk_score string, rationale string, evidence array<string>"
GUESSES = "guesses array<struct<type:string,value:string,confidence:double>>, can_identify boolean, confidence double"
CATEGORIES = "categories array<struct<category:string,confidence:double,reason:string>>"
# Entity labels of a recogniser and the categories that they tell. Fixed values.
ENTITY_CATEGORY = {"PERSON": "Personal", "ORG": "Contact", "GPE": "Location", "LOC": "Location", "FAC": "Location", "NORP": "Demographic", "DATE": "Demographic"}


def ask(rows: DataFrame, prompt: str, answer: str, factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """rows with the client's answer to the column prompt; different prompts are asked once and joined back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for b in batches:
            yield pd.DataFrame({prompt: b[prompt], answer: [client(p) for p in b[prompt]]})

    got = rows.select(prompt).where(F.col(prompt).isNotNull()).distinct().mapInPandas(run, f"{prompt} string, {answer} string")
    return rows.join(got, prompt, "left")


def json_in(answer: Column) -> Column:
    """The answer without thinking blocks, from its first brace to its last."""
    return F.regexp_extract(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0)


def parsed_decision(answer: Column, valid: Column) -> Column:
    """struct(decision, risk_score, evidence): deny at 0.7 for what cannot be read, 0.6 for a missing score; only valid evidence stays."""
    d = F.from_json(json_in(answer), DECISION)
    ok = F.lower(d["decision"]).isin("allow", "deny", "transform", "ask")
    return F.struct(F.when(ok, F.lower(d["decision"])).otherwise("deny").alias("decision"), F.when(ok, F.coalesce(F.expr("1.0D") * d["risk_score"].try_cast("double"), F.lit(0.6))).otherwise(0.7).alias("risk_score"), F.coalesce(F.filter(d["evidence"], lambda e: F.array_contains(valid, e)), F.array().cast("array<string>")).alias("evidence"))


def sensitive(answer: Column) -> Column:
    """Categories of an answer with a confidence over 0.3; one without a confidence is dropped."""
    c = F.coalesce(F.from_json(json_in(answer), CATEGORIES)["categories"], F.array().cast("array<struct<category:string,confidence:double,reason:string>>"))
    kept = F.filter(c, lambda x: F.coalesce(x["confidence"], F.lit(0.0)) > 0.3)
    return F.transform(kept, lambda x: F.struct(F.coalesce(x["category"], F.lit("Unknown")).alias("category"), x["confidence"].alias("confidence"), F.lit("llm").alias("method")))


def merged(keyword: Column, entity: Column, model: Column) -> Column:
    """Categories of three methods: a model's replace those of the same category, entities only add new ones."""
    has = lambda a, x: F.exists(a, lambda y: y["category"] == x["category"])
    rules = F.concat(keyword, F.filter(entity, lambda x: ~has(keyword, x)))
    return F.concat(model, F.filter(rules, lambda x: ~has(model, x)))


def identified(answer: Column, original: Column, threshold: float = 0.6) -> Column:
    """struct(confidence, can_identify): greatest confidence over guesses that the original verifies, and the answer's own if any is."""
    a = F.from_json(json_in(answer), GUESSES)
    g = F.filter(F.coalesce(a["guesses"], F.array().cast("array<struct<type:string,value:string,confidence:double>>")), lambda x: X.lexical_verified(F.coalesce(x["value"], F.lit("")), original))
    best = F.coalesce(F.array_max(F.transform(g, lambda x: F.coalesce(x["confidence"], F.lit(0.0)))), F.lit(0.0))
    conf = F.when(F.size(g) > 0, F.greatest(best, F.coalesce(a["confidence"], F.lit(0.0)))).otherwise(0.0)
    return F.struct(conf.alias("confidence"), (conf >= threshold).alias("can_identify"))


def accepted(candidate: Column, original: Column, fallback: Column, entities: Column, level: Column) -> Column:
    """The rewrite if it is not empty, not an echo and leaves no identifier that must change, else the fallback."""
    c = F.trim(F.coalesce(candidate, F.lit("")))
    must = F.filter(entities, lambda e: e["type"].isin(*T.ENTITIES) | (level >= 3))
    stays = F.exists(must, lambda e: F.contains(F.lower(c), F.lower(e["value"])))
    echo = (F.lower(c) == F.lower(F.trim(original))) & (fallback != original)
    return F.when((c == "") | echo | stays, fallback).otherwise(c)


def attribute_match(guess: Column, truth: Column) -> Column:
    """Either contains the other, they share a word of over two characters, or a number."""
    g, t = F.lower(F.trim(guess)), F.lower(F.trim(truth))
    words = lambda x: F.filter(F.split(x, r"[\s,]+"), lambda w: F.length(w) > 2)
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))
    return F.contains(g, t) | F.contains(t, g) | (F.size(F.array_intersect(words(g), words(t))) > 0) | (F.size(F.array_intersect(numbers(g), numbers(t))) > 0)


def presence(policy_text: Column) -> dict[str, Column]:
    """Signals of transparency that a policy's text shows."""
    low = F.lower(F.coalesce(policy_text, F.lit("")))
    has = lambda *words: X._any(low, list(words))
    return {"legal": has("consent", "legitimate interest", "legal basis"), "rights": has("your rights", "opt out", "opt-out", "delete your"), "retention": has("retain", "retention")}
