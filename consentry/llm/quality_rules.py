"""Quality rules: base rules, then robust outliers of each language and source.

Each document gives a vector of transformed statistics. Per language and source
the location and scatter of the vectors are estimated by the minimum covariance
determinant: from two deterministic starts, concentration steps keep the share
of vectors of the least Mahalanobis distance and estimate again; the start that
ends with the smaller determinant is used. A document whose distance to its
group's estimate is beyond a chi-square quantile is rejected.

All steps are sums over the table: a group may hold any share of the rows, and
only its sums meet. Groups below a least size are pooled by language and then
all together; a pool below that size gives no verdict, so its documents stay.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct")
#: The transformed statistics, and for each the least spread that is told apart from none.
FEATURES = {"log_words": 0.1, "word_length": 0.1, "symbols": 0.05, "dup_lines": 0.2, "repeats": 0.15, "upper": 0.02, "line_words": 0.2}
P = len(FEATURES)
#: Squared distance beyond which a document is rejected. The chi-square quantile at 1e-6 of 7 degrees of freedom is 40.5;
#: statistics of real texts have longer tails than normal ones, so the default is far beyond it.
CUTOFF = 100.0


def text_stats(text: bytes, window: int = 5) -> tuple[int, ...]:
    """STATS of a text; words are what bytes.split() gives, which is runs of other bytes than 0x20 and 0x09-0x0D."""
    w = text.split()
    chars = len(text.decode("utf-8", "replace"))
    blanks = sum(text.count(b) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(w) > window:
        grams = list(zip(*(w[k:] for k in range(window)), strict=False))
        if len(set(grams)) < len(grams):
            counts = Counter(grams)
            mark = bytearray(len(w))
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    mark[i : i + window] = b"\1" * window
            repeated = sum(mark)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(w), chars - blanks, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, len(set(w))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and STATS of every row of docs."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))

    def run(batches):
        for ids, texts, part in common.doc_batches(batches):
            got = np.array([text_stats(t) for t in texts], np.int64).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([common.id_array(ids), part.column("lang"), part.column("source"), *(pa.array(x) for x in got)], names=["doc_id", "lang", "source", *STATS])

    return given.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in STATS))


def base_failed(min_words: int = 10, repeat_share: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_share * F.col("n_words"))


def features() -> list[Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    x = [F.log1p("n_words"), F.col("word_chars") / words, F.log1p(20 * F.col("n_symbols") / words), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words), F.col("n_upper") / chars, F.log1p(words / lines)]
    return [c.alias(f"x{k}") for k, c in enumerate(x)]


def _distance(prefix: str) -> Column:
    """Squared Mahalanobis distance of x0.. under the columns <prefix>mu and <prefix>inv (arrays)."""
    d = [F.col(f"x{i}") - F.col(f"{prefix}mu")[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col(f"{prefix}inv")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))


def _moments(weight: Column | None) -> list[Column]:
    only = (lambda c: F.when(weight, c)) if weight is not None else (lambda c: c)
    xs = [F.col(f"x{i}") for i in range(P)]
    return [F.sum(only(F.lit(1.0))), *(F.sum(only(x)) for x in xs), *(F.sum(only(xs[i] * xs[j])) for i, j in itertools.combinations_with_replacement(range(P), 2))]


def _estimate(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse scatter with the least spreads added, and log-determinant, from _moments."""
    n = max(1.0, sums[0])
    mu = sums[1 : P + 1] / n
    cov = np.zeros((P, P))
    for k, (i, j) in enumerate(itertools.combinations_with_replacement(range(P), 2)):
        cov[i, j] = cov[j, i] = sums[P + 1 + k] / n - mu[i] * mu[j]
    return _inverse(mu, cov)


def _inverse(mu: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    cov = cov + np.diag(np.square(list(FEATURES.values())))
    return mu, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


_MODEL = "grp string, " + ", ".join(f"{s}mu array<double>, {s}inv array<double>, {s}det double" for s in ("a_", "b_"))


def _models(sums: DataFrame) -> DataFrame:
    """The two estimates of each group, from a row per group with arrays a and b of _moments."""

    def run(batches):
        for batch in batches:
            t = {c: batch.column(c).to_pylist() for c in ("grp", "a", "b")}
            out = {"grp": t["grp"]}
            for s in ("a", "b"):
                got = [_estimate(np.array(x, float)) for x in t[s]]
                out |= {f"{s}_mu": [g[0].tolist() for g in got], f"{s}_inv": [g[1].ravel().tolist() for g in got], f"{s}_det": [g[2] for g in got]}
            yield pa.RecordBatch.from_pydict(out)

    return sums.mapInArrow(run, _MODEL)


SALTS = 32


def _with_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows with their group's estimates; the rows of a group are spread over SALTS keys."""
    spread = models.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(spread, ["grp", "salt"])


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """rows with grp: language and source, or the pool that their small group went to, or null."""
    lang, source = (F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in ("lang", "source"))
    rows = rows.withColumns({"lk": lang, "gk": F.concat_ws("/", lang, source), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    own = rows.groupBy("lk", "gk").agg(F.count("*").alias("n"))
    own = own.select("*", (F.col("n") >= least).alias("large"))
    pools = own.where("not large").groupBy("lk").agg((F.sum("n") >= least).alias("pooled"), F.sum("n").alias("pn"))
    over = pools.where("not pooled").agg((F.coalesce(F.sum("pn"), F.lit(0)) >= least).alias("ok"))
    names = own.join(pools, "lk", "left").crossJoin(F.broadcast(over)).select("gk", F.when(F.col("large"), F.col("gk")).when(F.col("pooled"), F.concat(F.lit("pool:"), F.col("lk"))).when(F.col("ok"), F.lit("pool")).alias("grp"))
    spread = names.select("gk", "grp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(spread, ["gk", "salt"]).drop("lk", "gk")


def verdicts(stats: DataFrame, share: float = 0.75, steps: int = 2, least: int = 60, cutoff: float = CUTOFF, bins: int = 16) -> DataFrame:
    """stats (a stored table with a column row that numbers its rows) with base_failed, distance (squared, null without a verdict) and kept.

    share: of a group's vectors that each concentration step keeps; their
    greatest distance is found by exact counts in bins of 1/bins on a log scale,
    and the bin that it falls in is kept whole. Only documents that pass the base
    rules are estimated on. least: the smallest group with an estimate of its own.
    """
    given = stats.withColumn("base_failed", base_failed())
    vectors = common.stored(_grouped(given.where("not base_failed").select("row", "doc_id", "lang", "source", *features()), least).drop("lang", "source", "doc_id"), "vectors")
    scored = vectors.where(F.col("grp").isNotNull())
    xs = [F.col(f"x{i}") for i in range(P)]
    mid = scored.groupBy("grp").agg(F.array(*[F.percentile_approx(x, 0.5, 1000) for x in xs]).alias("mid"))
    spread_mid = mid.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mad = scored.join(spread_mid, ["grp", "salt"]).groupBy("grp").agg(F.first("mid").alias("mid"), F.array(*[F.percentile_approx(F.abs(x - F.col("mid")[i]), 0.5, 1000) for i, x in enumerate(xs)]).alias("mad"), F.array(*_moments(None)).alias("b"))
    # start a: medians, and deviations from them, as moments of one vector of weight 1
    one = [F.lit(1.0), *(F.col("mid")[i] for i in range(P)), *(F.col("mid")[i] * F.col("mid")[j] + (F.pow(1.4826 * F.col("mad")[i], 2) if i == j else F.lit(0.0)) for i, j in itertools.combinations_with_replacement(range(P), 2))]
    models = common.stored(_models(mad.select("grp", F.array(*one).alias("a"), "b")), "models")
    for _ in range(steps):
        met = _with_models(scored, models)
        d = met.select("grp", "salt", *xs, *(F.floor(bins * F.log(_distance(s) + 1e-9)).alias(f"{s}bin") for s in ("a_", "b_")))
        d = common.stored(d, "distances")
        cuts = []
        for s in ("a_", "b_"):
            counts = d.groupBy("grp", f"{s}bin").agg(F.count("*").alias("n"))
            listed = counts.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct(F.col(f"{s}bin").alias("bin"), "n"))).alias("h"), F.sum("n").alias("all"))
            run = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("cut")), lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.coalesce(acc["cut"], F.when(acc["seen"] + x["n"] >= F.col("all") * share, x["bin"])).alias("cut")))
            cuts.append(listed.select("grp", run["cut"].alias(f"{s}cut")))
        cut = cuts[0].join(cuts[1], "grp").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        sums = d.join(cut, ["grp", "salt"]).groupBy("grp").agg(F.array(*_moments(F.col("a_bin") <= F.col("a_cut"))).alias("a"), F.array(*_moments(F.col("b_bin") <= F.col("b_cut"))).alias("b"))
        after = common.stored(_models(sums), "models")
        common.drop_stored(models)
        common.drop_stored(d)
        models = after
    best = models.select("grp", *(F.when(F.col("a_det") <= F.col("b_det"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"c_{c}") for c in ("mu", "inv")))
    # the kept share of a normal sample has too small a scatter: its median distance is set to the chi-square median
    far = _with_models(scored, best).select("row", "grp", "salt", _distance("c_").alias("d"))
    factor = far.groupBy("grp").agg((F.percentile_approx("d", 0.5, 1000) / F.lit(6.346)).alias("f")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    distance = far.join(factor, ["grp", "salt"]).select("row", (F.col("d") / F.greatest(F.col("f"), F.lit(1.0))).alias("distance"))
    out = given.join(distance, "row", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).drop("row")


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """Every row of docs with STATS, base_failed, distance and kept.

    An empty or null text has no words and fails the base rules. Null languages
    and sources are groups of their own.
    """
    return verdicts(common.stored(statistics(docs).withColumn("row", F.monotonically_increasing_id()), "statistics"), **options)
