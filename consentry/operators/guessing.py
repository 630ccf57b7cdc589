"""Guess-and-rewrite loops: a frontier of unsettled texts, asked again each round.

A round anonymises the frontier, each text at its own level only, and writes it to a table, a masked text that is the
original once. Texts at the cap are settled there; those below are asked about, moved with their answers
and written again, and only those not settled go on. A round's
answers are in the log of calls, its frontier is a table, so a lost executor costs no questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import shared
from . import anonymize, calls, models

GUESSES = "guesses array<struct<guess:string,confidence:double>>, max_confidence double"
_GUESS = "array<struct<guess:string,confidence:double>>"


def verifier(mode: str = "lexical", semantic: Callable[[Column, Column], Column] | None = None) -> Callable[[Column, Column], Column]:
    """Whether a guess fits the original: off (always), lexical, or semantic by the given test (without one: lexical)."""
    if mode not in ("off", "lexical", "semantic"):
        raise ValueError(f"no verifier {mode!r}")
    if mode == "off":
        return lambda guess, original: F.lit(True)
    if mode == "semantic" and semantic is not None:
        return lambda guess, original: F.coalesce(semantic(guess, original), X.lexical_verified(guess, original))
    return X.lexical_verified


def guessed(answer: Column, original: Column | None = None, verify: Callable[[Column, Column], Column] = X.lexical_verified, threshold: float = 0.6) -> Column:
    """struct(verified, confidence, can_identify) of a guesser's answer.

    With an original only guesses that it verifies count, and the answer's own confidence only if one does; without one all
    do. An answer that cannot be read tells nothing.
    """
    a = F.from_json(calls.unfenced(answer), GUESSES)
    all_ = F.coalesce(a["guesses"], F.array().cast(_GUESS))
    kept = all_ if original is None else F.filter(all_, lambda g: F.coalesce(verify(F.coalesce(g["guess"], F.lit("")), original), F.lit(False)))
    best = F.coalesce(F.array_max(F.transform(kept, lambda g: F.coalesce(g["confidence"], F.lit(0.0)))), F.lit(0.0))
    own = F.coalesce(a["max_confidence"], F.lit(0.0))
    trusted = F.lit(True) if original is None else F.size(kept) > 0
    confidence = F.when(trusted, F.greatest(best, own)).otherwise(best)
    return F.struct(F.size(kept).alias("verified"), confidence.alias("confidence"), (confidence >= threshold).alias("can_identify"))


def guess_prompt(text: Column, context: Column | None = None) -> Column:
    about = F.lit("") if context is None else F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\nAdditional context: "), context)).otherwise("")
    return F.concat(F.lit('Anonymized text: "'), text, F.lit('"'), about, F.lit("\n\nTry to guess what was redacted. Return JSON only."))


def rewrite_prompt(text: Column, level: Column) -> Column:
    return F.concat(F.lit("Anonymize at Level "), level.cast("string"), F.lit(':\n\nOriginal: "'), text, F.lit('"\n\nReturn JSON only.'))


def _packed(rows: DataFrame, text: str) -> DataFrame:
    """rows with _same and _masked in the place of anonymized, which is stored only where it is not the text itself."""
    same = F.col("anonymized").eqNullSafe(F.col(text))
    return rows.withColumns({"_same": same, "_masked": F.when(~same, F.col("anonymized"))}).drop("anonymized")


def _unpacked(text: str) -> Column:
    return F.when(F.col("_same"), F.col(text)).otherwise(F.col("_masked"))


def loop(
    rows: DataFrame,
    start: Column,
    guesser: Callable[[int], Callable[[str], str]] | None,
    log: str,
    text: str = "text",
    cap: int = 3,
    max_rounds: int = 5,
    rewriter: Callable[[int], Callable[[str], str]] | None = None,
    rewrite_from: int = 4,
    named: str | None = None,
    context: str | None = None,
    verify: Callable[[Column, Column], Column] = X.lexical_verified,
    attempts: int = 3,
    wait: Callable[[float], None] | None = None,
) -> DataFrame:
    """rows with anonymized, initial_level, final_level, rounds, guesses (rounds that asked), confidence (of the last guess) and upgraded.

    A text begins at start, at most cap, and goes up a level while the guesser can identify
    what was taken out; at the cap it is not asked about. If the rounds run out after a step up, the text is that of
    the level before. rewriter: a client that rewrites at the levels from rewrite_from on, accepted as models.accepted has
    it, else the text masked at most at level 3. Without a guesser the first level stays. A guesser's failure counts as nothing identified.
    """
    own = rows.columns
    options = {"attempts": attempts} | ({"wait": wait} if wait else {})
    frontier = rows.withColumn("initial_level", F.least(start, F.lit(cap)).cast("int"))
    frontier = frontier.withColumns({"_level": F.col("initial_level"), "_guesses": F.lit(0), "confidence": F.lit(None).cast("double")})
    done = []
    for number in range(1, max_rounds + 1):
        now = anonymize.masked(frontier, F.col("_level"), text, named)
        if rewriter is not None:
            now = shared.written(_packed(now, text), "masked")
            now = now.withColumn("anonymized", _unpacked(text))
            wanted = F.when(F.col("_level") >= rewrite_from, rewrite_prompt(F.coalesce(text, F.lit("")), F.col("_level")))
            asked = calls.ask(now.withColumn("_prompt", wanted), "_prompt", rewriter, f"{log}/rewrites", **options)
            candidate = F.get_json_object(calls.unfenced(F.col("answer")), "$.anonymized")
            better = models.accepted(candidate, F.coalesce(text, F.lit("")), F.col("anonymized"), F.col("entities"), F.col("_level"))
            now = asked.withColumn("anonymized", F.when(F.col("_prompt").isNotNull(), better).otherwise(F.col("anonymized"))).drop("_prompt", "_same", "_masked", "answer", "error", "attempts")
        now = shared.written(_packed(now.drop("entities"), text).withColumn("_rounds", F.lit(number)), "frontier")
        below = F.col("_level") < cap
        if guesser is None:
            done.append(now)
            break
        done.append(now.where(~below))
        prompt = guess_prompt(_unpacked(text), F.col(context) if context else None)
        asked = calls.ask(now.where(below).withColumn("_prompt", prompt), "_prompt", guesser, f"{log}/guesses", **options)
        asked = asked.withColumn("_g", guessed(F.col("answer"), F.coalesce(text, F.lit("")), verify))
        asked = asked.withColumns({"_up": F.coalesce(F.col("_g.can_identify"), F.lit(False)), "confidence": F.col("_g.confidence"), "_guesses": F.col("_guesses") + 1}).drop("_prompt", "answer", "error", "attempts", "_g")
        last = number == max_rounds
        asked = asked.withColumns({"_level": F.col("_level") + F.col("_up").cast("int"), "_settled": ~F.col("_up") | F.lit(last)})
        asked = shared.written(asked.drop("_up"), "round", "_settled")
        done.append(asked.where("_settled").drop("_settled"))
        frontier = asked.where("not _settled").drop("_settled", "_same", "_masked", "_rounds")
        if last or not frontier.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*own, _unpacked(text).alias("anonymized"), "initial_level", F.col("_level").alias("final_level"), F.col("_rounds").alias("rounds"), F.col("_guesses").alias("guesses"), "confidence", (F.col("_level") > F.col("initial_level")).alias("upgraded"))


def refined(rows: DataFrame, text: str, infer: Callable[[int], Callable[[str], str]], rewrite: Callable[[int], Callable[[str], str]], log: str, max_rounds: int = 3, most_chars: int = 800, attempts: int = 3, wait: Callable[[float], None] | None = None) -> DataFrame:
    """rows with anonymized, rounds and upgraded: what can be inferred is asked, then a rewrite against it, until a rewrite changes nothing.

    Up to five inferences of a round go into the rewrite's prompt. Of a rewrite that is no JSON
    object what follows its first # is taken, or all of it; an empty one or a failed call leaves the text.
    """
    own = rows.columns
    options = {"attempts": attempts} | ({"wait": wait} if wait else {})
    item = "inferences array<struct<type:string,inference:string,guess:string>>"
    frontier = shared.written(rows.withColumn("_now", F.coalesce(F.col(text), F.lit(""))), "frontier")
    done = []
    for number in range(1, max_rounds + 1):
        question = F.concat(F.lit('Guess what the author of this text is like.\n\nText: "'), F.col("_now"), F.lit('"\n\nReturn JSON only.'))
        x = calls.ask(frontier.withColumn("_prompt", question), "_prompt", infer, f"{log}/inferences", **options)
        found = F.slice(F.coalesce(F.from_json(calls.unfenced(F.col("answer")), item)["inferences"], F.array().cast("array<struct<type:string,inference:string,guess:string>>")), 1, 5)
        part = lambda s, n: F.left(F.coalesce(s, F.lit("")), F.lit(n))
        lines = F.array_join(F.transform(found, lambda i: F.concat(F.lit("Type: "), F.coalesce(i["type"], F.lit("")), F.lit("\nInference: "), part(i["inference"], 120), F.lit("\nGuess: "), part(i["guess"], 60))), "\n\n")
        order = F.concat(F.lit("Rewrite the text so that this cannot be inferred.\n\n"), part(F.col("_now"), most_chars), F.lit("\n\nInferences:\n\n"), part(F.when(lines == "", "(no inferences)").otherwise(lines), most_chars), F.lit("\n\nReturn JSON only."))
        x = x.withColumn("_prompt", order).drop("answer", "error", "attempts")
        x = calls.ask(x, "_prompt", rewrite, f"{log}/refined", **options)
        read = calls.unfenced(F.col("answer"))
        stripped = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
        fields = [stripped(F.get_json_object(read, f"$.{k}")) for k in ("anonymized", "rewritten", "text", "answer")]
        plain = F.when(F.from_json(read, "map<string,string>").isNull(), F.when(F.contains(read, F.lit("#")), F.substr(read, F.instr(read, F.lit("#")) + 1)).otherwise(read))
        text_of = F.coalesce(*fields, stripped(plain), part(F.col("_now"), most_chars))
        x = x.withColumn("_new", text_of).withColumns({"_rounds": F.lit(number), "_settled": (F.col("_new") == F.col("_now")) | F.lit(number == max_rounds)})
        x = shared.written(x.withColumn("_now", F.col("_new")).drop("_new", "_prompt", "answer", "error", "attempts"), "round", "_settled")
        done.append(x.where("_settled").drop("_settled"))
        frontier = x.where("not _settled").drop("_settled", "_rounds")
        if number == max_rounds or not frontier.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*own, F.col("_now").alias("anonymized"), F.col("_rounds").alias("rounds"), (F.col("_rounds") > 1).alias("upgraded"))
