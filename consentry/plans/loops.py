"""Queries of model calls, guess-and-rewrite loops, configuration runs, training and token matching.

Clients here are fixed rules in the place of a model; the operators take any.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import tables as T
from ..functions import text as X
from ..operators import alignment, calls, features, guessing, paths, training
from ..sources import shared
from . import text_twin as TT
from . import twin
from .inputs import ctes, frame, table


def _no_wait(seconds: float) -> None:
    """The rules below need no rest."""


def _rater(attempt: int):
    """Rates by the prompt's length; every third prompt times out at first, every fifth is refused, every seventh gets no ratings."""

    def answer(prompt: str) -> str:
        n = len(prompt)
        if n % 5 == 0:
            raise PermissionError("refused")
        if n % 3 == 0 and attempt < 2:
            raise TimeoutError("busy")
        if n % 7 == 0:
            return "no ratings" if attempt < 3 else '{"privacy": "high"}'
        return f'```json\n{{"privacy": {n % 9}, "utility": {n % 4}.0}}\n```'

    return answer


_PROMPT = "'ORIGINAL:' || chr(10) || a.text || chr(10) || 'ANONYMIZED:' || chr(10) || b.text"


@query(
    "lm06_rated_with_retries",
    f"""WITH p AS (SELECT a.conv_id, a.turn, length({_PROMPT}) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, CASE WHEN n % 5 = 0 THEN 'PermissionError' WHEN n % 7 = 0 THEN 'InvalidAnswer' END AS error, CASE WHEN n % 5 = 0 THEN 1 WHEN n % 7 = 0 THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS attempts,
      CASE WHEN n % 5 > 0 AND n % 7 > 0 THEN greatest(1, least(5, n % 9)) END AS privacy, CASE WHEN n % 5 > 0 AND n % 7 > 0 THEN greatest(1, n % 4) END AS utility, CASE WHEN n % 5 > 0 AND n % 7 > 0 THEN 1 END AS fluency FROM p""",
)
def lm06(spark, sf):
    """Each turn rated against the next, at most three attempts, answers read from the log."""
    c = table(spark, sf, "conversations").where("text is not null")
    a, b = c.select("conv_id", "turn", F.col("text").alias("ta")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tb"))
    prompts = a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.concat(F.lit("ORIGINAL:\n"), "ta", F.lit("\nANONYMIZED:\n"), "tb").alias("prompt"))
    got = calls.ask(prompts, "prompt", _rater, shared.path(spark, "ratings"), attempts=3, valid=lambda x: calls.rated(x).isNotNull(), wait=_no_wait)
    return got.withColumn("r", calls.rated(F.col("answer"))).select("conv_id", "turn", "error", "attempts", "r.privacy", "r.utility", "r.fluency")


def _guesser(attempt: int):
    """Sees through a mask that leaves an address's domain or the end of a number, and names a word that is left."""

    def answer(prompt: str) -> str:
        text = prompt.split('"')[1] if '"' in prompt else ""
        if "@" in text or "****" in text:
            return '{"guesses": [{"guess": "%s", "confidence": 0.7}, {"guess": "zzzz", "confidence": 0.9}], "max_confidence": 0.65}' % next((w for w in text.split() if len(w) > 2 and w.isascii() and w.isalpha()), "")
        return '{"guesses": [{"guess": "zzzz", "confidence": 0.9}], "max_confidence": 0.9}'

    return answer


_LEVELS = f"WITH {TT.PATTERNS}, lv AS (SELECT doc_id, text, {TT.levels('rx')} FROM rx)"
#: What the guesser above reads of a prompt is the text up to its first quotation mark.
_SEEN = "split_part({t}, '\"', 1)"
_WORD = "list_filter(regexp_split_to_array(SEEN, '\\s+'), lambda w: length(w) > 2 AND regexp_full_match(w, '[A-Za-z]+'))[1]"
_KNOWN = "contains(lower(text), lower(WORD)) OR list_has_any(list_filter(regexp_split_to_array(lower(WORD), '\\s+'), lambda w: length(w) > 2), list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2))"
_IDENTIFIED = f"((strpos(SEEN, '@') > 0 OR strpos(SEEN, '****') > 0) AND ({_KNOWN.replace('WORD', 'coalesce(' + _WORD + ', ' + repr('') + ')')}))".replace("SEEN", _SEEN)


@query("an12_guess_loop", f"{_LEVELS}, {TT.adaptive('lv', '(doc_id % 10 / 10.0)', _IDENTIFIED)} SELECT doc_id, initial_level, final_level, rounds, rounds - CASE WHEN final_level = 3 THEN 1 ELSE 0 END AS guesses, upgraded, md5(anonymized) AS digest FROM ad")
def an12_loop(spark, sf):
    """The adaptive loop with a guesser whose guesses the original verifies; only unsettled texts are asked about again."""
    from ..functions import risk as R

    d = table(spark, sf, "documents").select("doc_id", "text")
    x = guessing.loop(d, R.level(F.col("doc_id") % 10 / F.lit(10.0)), _guesser, shared.path(spark, "loop"), wait=_no_wait)
    return x.select("doc_id", "initial_level", "final_level", "rounds", "guesses", "upgraded", F.md5("anonymized").alias("digest"))


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


_FIELDS = "['sich', 'the', 'example.com', '4087']"
_UTILITY = _jaccard(twin.TOKENS.format("text"), twin.TOKENS.format("anonymized"))


@query(
    "an16_configurations",
    f"""{_LEVELS}, {TT.adaptive('lv', '(doc_id % 10 / 10.0)', _IDENTIFIED)},
    r AS (SELECT 'masked' AS config, doc_id, text, initial_level AS level, CASE initial_level WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END AS anonymized, false AS upgraded FROM ad UNION ALL SELECT 'guessed', doc_id, text, final_level, anonymized, upgraded FROM ad),
    e AS (SELECT config, text, CASE WHEN doc_id % 50 = 7 THEN text ELSE anonymized END AS anonymized, CASE WHEN doc_id % 50 = 7 THEN 0 ELSE level END AS level, doc_id % 50 = 7 AS failed, doc_id % 50 <> 7 AND upgraded AS upgraded FROM r)
    SELECT config, count(*) AS n, count(*) FILTER (failed) AS errors, count(*) FILTER (upgraded) AS upgraded, round(avg({_UTILITY}), 6) AS avg_utility, round(avg(1.0 - len(list_filter({_FIELDS}, lambda x: contains(lower(anonymized), lower(x)))) / 4.0), 6)::DOUBLE AS avg_privacy, round(avg(level), 6) AS avg_level,
      quantile_disc(level, 0.95)::DOUBLE AS level_p95 FROM e GROUP BY 1""",
)
def an16_configurations(spark, sf):
    """Two configurations over all documents; one sample in fifty counts as failed, and keeps its text at level 0."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "text", (F.col("doc_id") % 10 / F.lit(10.0)).alias("risk_score"), F.array(*map(F.lit, ("sich", "the", "example.com", "4087"))).alias("sensitive_fields"))
    configurations = {"masked": paths.masked_only(), "guessed": paths.guessed(_guesser, shared.path(spark, "paths"), max_rounds=5, wait=_no_wait)}
    got = paths.benchmark(d, configurations, shared.path(spark, "sketches"), "run", lambda name: F.when(F.col("sample_id") % 50 == 7, "TimeoutError"))
    return got.select("config", "n", "errors", "upgraded", *(F.round(f"avg_{m}", 6).alias(f"avg_{m}") for m in paths.MEASURES), "level_p95")


_VEC = "(('0x' || left(md5(token), 8))::BIGINT % (SELECT count(*) FROM embeddings))"


@query(
    "lm08_greedy_matching",
    f"""WITH w AS (SELECT conv_id, turn, list_distinct({twin.TOKENS.format('text')}) AS t FROM conversations WHERE text IS NOT NULL),
    p AS (SELECT a.conv_id, a.turn, a.t AS ta, b.t AS tb FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    x AS (SELECT conv_id, turn, token AS ta, v AS va FROM (SELECT conv_id, turn, unnest(ta) AS token FROM p) JOIN e ON vec_id = {_VEC}),
    y AS (SELECT conv_id, turn, token AS tb, v AS vb FROM (SELECT conv_id, turn, unnest(tb) AS token FROM p) JOIN e ON vec_id = {_VEC}),
    s AS (SELECT conv_id, turn, ta, tb, list_cosine_similarity(va, vb) AS s FROM x JOIN y USING (conv_id, turn)),
    pr AS (SELECT conv_id, turn, avg(s) AS precision FROM (SELECT conv_id, turn, ta, max(s) AS s FROM s GROUP BY ALL) GROUP BY ALL),
    re AS (SELECT conv_id, turn, avg(s) AS recall FROM (SELECT conv_id, turn, tb, max(s) AS s FROM s GROUP BY ALL) GROUP BY ALL)
    SELECT conv_id, turn, round(coalesce(precision, 0), 5) AS precision, round(coalesce(recall, 0), 5) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 5) AS f1 FROM p LEFT JOIN pr USING (conv_id, turn) LEFT JOIN re USING (conv_id, turn)""",
)
def lm08(spark, sf):
    """Each turn's different tokens matched to the next turn's; a token's vector is the one at its md5."""
    c = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    words = c.select(F.explode("t").alias("token")).distinct()
    vectors = words.withColumn("vec_id", F.conv(F.left(F.md5("token"), F.lit(8)), 16, 10).cast("long") % e.count()).join(e, "vec_id").select("token", "vector")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("tb"))
    pairs = c.withColumnRenamed("t", "ta").join(b, ["conv_id", "turn"]).withColumn("pair", F.concat_ws("/", "conv_id", "turn"))
    s = alignment.greedy_scores(pairs, "pair", "ta", "tb", vectors)
    part = lambda k: F.get(F.split("pair", "/"), F.lit(k)).cast("long")
    return s.select(part(0).alias("conv_id"), part(1).alias("turn"), *(F.round(m, 5).alias(m) for m in ("precision", "recall", "f1")))


def behaviour_examples(spark, sf):
    """id, x and y: each behaviour's vector beside its statement's, and whether it goes against the statement."""
    s = frame(spark, sf, "statements")
    own = s.select(F.col("id").alias("statement_id"), features.behaviour_vector(F.col("data_categories"), F.col("actions"), F.col("purposes")).alias("policy"))
    b = features.behaviours(s).join(own, "statement_id")
    vector = features.behaviour_vector(F.col("data_categories"), F.array().cast("array<string>"), F.col("purposes"))
    return b.select(F.concat_ws("|", "statement_id", "kind").alias("id"), F.concat(vector, "policy").alias("x"), (F.col("kind") != "compliant").cast("int").alias("y"))


WIDTH = 2 * (len(T.VOCAB_DATA) + len(T.VOCAB_ACTIONS) + len(T.VOCAB_PURPOSES))


@query("ml07_training_history")
def ml07(spark, sf):
    """The evidential net trained on all behaviours for three epochs; the checkpoint table's history, the kept epoch marked."""
    data = training.examples(behaviour_examples(spark, sf), F.col("id"), F.col("x"), F.col("y"), shared.path(spark, "examples"), batches=2)
    where = shared.path(spark, "checkpoints")
    history = training.train(data, training.Net((WIDTH, 16, 2)), where, epochs=3, batches=2, rate=0.02)
    kept = training.checkpoint(spark, where)["epoch"]
    return history.select("epoch", "step", *(F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "val_accuracy")), (F.col("epoch") == kept).alias("kept"))
