"""Evaluation metrics over long tables of results: classification, rank correlation, calibration, agreement, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(a / b)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def per_class(rows: DataFrame, gold: str, pred: str, labels: list[str] | None = None) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) of each label: those given, else all seen in either column."""
    each = rows.select(F.explode(F.array_distinct(F.array(gold, pred))).alias("label"), F.col(gold).alias("g"), F.col(pred).alias("p"))
    c = each.groupBy("label").agg(F.count_if((F.col("g") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"), F.count_if((F.col("g") != F.col("label")) & (F.col("p") == F.col("label"))).alias("fp"), F.count_if((F.col("g") == F.col("label")) & (F.col("p") != F.col("label"))).alias("fn"))
    if labels:
        names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
        c = names.join(c, "label", "left").fillna(0)
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def binary(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 and accuracy; empty denominators count as one."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    c = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    one = F.lit(1)
    pr, re = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))
    return c.select("*", pr.alias("precision"), re.alias("recall"), (2 * pr * re / F.greatest(F.lit(1e-9), pr + re)).alias("f1"), ((F.col("tp") + F.col("tn")) / F.greatest(one, F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"))


def confusion(rows: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """(gold, pred, n) for every pair of labels, zeros included."""
    one = rows.sparkSession.range(1)
    names = one.select(F.explode(F.array(*map(F.lit, labels))).alias("gold"), F.array(*map(F.lit, labels)).alias("p")).select("gold", F.explode("p").alias("pred"))
    n = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return names.join(n, ["gold", "pred"], "left").fillna(0, ["n"])


def dealt(rows: DataFrame, by: list[str], each: int = 250_000) -> DataFrame:
    """rows by their groups in so many tasks that each sorts some each rows, however many rows there are."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // each)), *by)


def average_ranks(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """rows with the fractional rank of value within by; equal values share the mean of their ranks."""
    return _ranked(dealt(rows, by), value, by, name)


def _ranked(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.rank().over(W.Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.Window.partitionBy(*by, value)) - 1) / F.lit(2.0))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho): 1 - 6 sum d^2 / (n (n^2 - 1)) over average ranks; 0 for fewer than two rows."""
    r = _ranked(_ranked(dealt(rows.select(*by, x, y), by), x, by, "rx"), y, by, "ry").groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("rx") - F.col("ry"), 2)).alias("d2"))
    n = F.col("n").cast("double")
    return r.select(*by, "n", F.when(F.col("n") < 2, 0.0).otherwise(1 - 6 * F.col("d2") / (n * (n * n - 1))).alias("rho"))


def pearson(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, r); 0 where a side does not vary."""
    a = rows.groupBy(*by).agg(F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return a.select(*by, F.when((F.col("sx") * F.col("sy")) == 0, 0.0).otherwise(F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("r"))


def errors(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    d = F.col(x) - F.col(y)
    return rows.groupBy(*by).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def calibration(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of bins min(floor(c * bins), bins - 1)."""
    b = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def ece(reliability: DataFrame) -> DataFrame:
    return reliability.agg(_ratio(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")).alias("ece"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share; (0, 0) without trials."""
    p = k / F.greatest(n, F.lit(1))
    den = 1 + z * z / F.greatest(n, F.lit(1))
    mid, half = (p + z * z / (2 * F.greatest(n, F.lit(1)))) / den, z * F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)) + z * z / (4 * F.greatest(n, F.lit(1)) * F.greatest(n, F.lit(1)))) / den
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


def fisher(rho: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a correlation by Fisher's transformation; null where it has none."""
    ok = (rho > -1) & (rho < 1) & (n > 3)
    zr = 0.5 * F.ln((1 + rho) / (1 - rho))
    half = z / F.sqrt(F.greatest(n - 3, F.lit(1)).cast("double"))
    back = lambda v: (F.exp(2 * v) - 1) / (F.exp(2 * v) + 1)
    return F.when(ok, back(zr - half)), F.when(ok, back(zr + half))


def resample(rows: DataFrame, by: list[str], draws: int, seed: int = 42) -> DataFrame:
    """rows drawn with replacement, draws times per group: columns of rows and draw.

    Row number i of a group of n takes, in draw b, the row md5(seed|b|i) modulo n, so any
    engine draws the same. rows needs a column i that numbers each group from 0.
    """
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    slots = rows.select(*by, "i").join(n, by).select(*by, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    return slots.select(*by, "draw", (h % F.col("n")).alias("i")).join(rows, [*by, "i"])


def bootstrap_mean(rows: DataFrame, value: str, by: list[str], draws: int = 200, seed: int = 42) -> DataFrame:
    """(by, mean, lo, hi): mean of the draws' means and their values at places int(0.025 B) and int(0.975 B) in ascending order."""
    m = resample(rows, by, draws, seed).groupBy(*by, "draw").agg(F.round(F.avg(value), 9).alias("m"))
    r = m.withColumn("r", F.row_number().over(W.Window.partitionBy(*by).orderBy("m")) - 1)
    return r.groupBy(*by).agg(F.avg("m").alias("mean"), F.max(F.when(F.col("r") == int(0.025 * draws), F.col("m"))).alias("lo"), F.max(F.when(F.col("r") == int(0.975 * draws), F.col("m"))).alias("hi"))


def paired_bootstrap(rows: DataFrame, difference: str, by: list[str], draws: int = 200, seed: int = 42) -> DataFrame:
    """(by, mean_diff, p_sign, p_centred): two-sided values of paired differences.

    p_sign: twice the smaller share of draws' means on either side of 0. p_centred: share of
    centred draws' means at least as far from 0 as the mean; 1 if the mean is 0.
    """
    mean = rows.groupBy(*by).agg(F.avg(difference).alias("mean_diff"))
    m = resample(rows, by, draws, seed).groupBy(*by, "draw").agg(F.avg(difference).alias("m")).join(mean, by)
    far = F.round(F.abs(F.col("m") - F.col("mean_diff")), 9) >= F.round(F.abs(F.col("mean_diff")), 9)
    low, high = F.avg((F.round("m", 9) <= 0).cast("double")), F.avg((F.round("m", 9) >= 0).cast("double"))
    return m.groupBy(*by, "mean_diff").agg(F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p_sign"), F.avg(far.cast("double")).alias("p_centred")).withColumn("p_centred", F.when(F.col("mean_diff") == 0, 1.0).otherwise(F.col("p_centred")))


def holm(rows: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """rows with significant: Holm's step-down; the first failure stops all later ones. For small tables of tests."""
    w = W.Window.orderBy(p, key)
    n = F.count("*").over(W.Window.partitionBy(F.lit(1)))
    failed = (F.col(p) > alpha / (n - F.row_number().over(w) + 1)).cast("int")
    x = rows.withColumn("_failed", failed)
    return x.withColumn("significant", F.max("_failed").over(w.rowsBetween(W.Window.unboundedPreceding, 0)) == 0).drop("_failed")


def pareto(rows: DataFrame, utility: str, privacy: str, by: list[str], key: str) -> DataFrame:
    """Rows that no other of the group beats in both: by privacy downwards, utility above all before."""
    w = W.Window.partitionBy(*by).orderBy(F.col(privacy).desc(), F.col(utility).desc(), key)
    best = F.max(utility).over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    return rows.withColumn("_best", best).where(F.col(utility) > F.coalesce("_best", F.lit(-1.0))).drop("_best")


def majority(rows: DataFrame, by: list[str], vote: str, least: int = 1) -> DataFrame:
    """(by, vote, votes): the most frequent vote (ties: the smaller); null below least votes for it."""
    c = rows.groupBy(*by, vote).agg(F.count("*").alias("votes"))
    top = c.withColumn("r", F.row_number().over(W.Window.partitionBy(*by).orderBy(F.col("votes").desc(), vote))).where("r = 1")
    return top.select(*by, F.when(F.col("votes") >= least, F.col(vote)).alias(vote), "votes")


def krippendorff(rows: DataFrame, unit: str, value: str, by: list[str]) -> DataFrame:
    """(by, alpha) for interval values: 1 - observed over expected disagreement; units with one rating do not count.

    Both come from sums: for weights w, the sum over pairs of (a - b)^2 is 2 (W sum w a^2 - (sum w a)^2).
    """
    u = rows.where(F.col(value).isNotNull()).groupBy(*by, unit).agg(F.count("*").alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).where("m > 1")
    a = u.groupBy(*by).agg(F.sum("m").alias("n"), F.sum((2 * F.col("m") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("observed"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    expected = (2 * F.col("n") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("n") - 1)
    return a.select(*by, F.when(expected == 0, 1.0).otherwise(1 - F.try_divide(F.col("observed"), expected)).alias("alpha"))


def fixed_labels(rows: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """(label, precision, recall, f1) of each given label, found or not; empty denominators count as one."""
    c = rows.agg(*[F.count_if((F.col(gold) == k) & (F.col(pred) == k)).alias(f"tp_{k}") for k in labels], *[F.count_if(F.col(pred) == k).alias(f"p_{k}") for k in labels], *[F.count_if(F.col(gold) == k).alias(f"g_{k}") for k in labels])
    each = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"tp_{k}").alias("tp"), F.col(f"p_{k}").alias("p"), F.col(f"g_{k}").alias("g")) for k in labels])).alias("x")).select("x.*")
    pr, re = F.col("tp") / F.greatest(F.lit(1), F.col("p")), F.col("tp") / F.greatest(F.lit(1), F.col("g"))
    return each.select("label", pr.alias("precision"), re.alias("recall"), (2 * pr * re / F.greatest(F.lit(1e-9), pr + re)).alias("f1"))


def krippendorff_ordinal(rows: DataFrame, unit: str, value: str, by: list[str]) -> DataFrame:
    """(by, alpha) for ordered values. The distance of two values is the square of the ratings from one to the other, half of those at the ends.

    Coincidences come from counts per unit and value, so their number is that of the values, not of the ratings.
    """
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, unit, value).agg(F.count("*").cast("double").alias("n"))
    m = n.groupBy(*by, unit).agg(F.sum("n").alias("m")).where("m > 1")
    n = n.join(m, [*by, unit])
    margin = n.groupBy(*by, value).agg(F.sum("n").alias("all"))
    up = W.Window.partitionBy(*by).orderBy(value)
    place = margin.withColumn("place", F.sum("all").over(up) - F.col("all") / 2)
    x = n.join(place.select(*by, value, "place"), [*by, value])
    # with places as values the distance is a plain square, so sums do as for intervals
    u = x.groupBy(*by, unit, "m").agg(F.sum(F.col("n") * F.col("place")).alias("s"), F.sum(F.col("n") * F.col("place") * F.col("place")).alias("q"))
    a = u.groupBy(*by).agg(F.sum("m").alias("t"), F.sum((2 * F.col("m") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("observed"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    expected = (2 * F.col("t") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("t") - 1)
    return a.select(*by, F.when(expected == 0, 1.0).otherwise(1 - F.try_divide(F.col("observed"), expected)).alias("alpha"))


def examples(ours: DataFrame, baseline: DataFrame, key: str, category: str, value: str, order: str, categories: int = 5, losses: int = 2, most: int = 10) -> DataFrame:
    """(key, place) of rows to show: the best and the worst by value of each of the first categories, then the greatest losses.

    A category is what precedes the first bar in it (null: unknown); categories count in the order of their first row.
    Of equal values the first row is the best, the last the worst; a category's only row is shown once. A
    loss is a baseline's greater value of the same key; of equal gaps the greater key comes first. A key is shown once, at its first place, and at most most are.
    """
    rows = ours.select(key, F.coalesce(F.get(F.split(category, r"\|"), F.lit(0)), F.lit("unknown")).alias("c"), F.col(value).alias("v"), F.col(order).alias("o"))
    rank = F.struct("v", (-F.col("o")).alias("o"))
    each = rows.groupBy("c").agg(F.min("o").alias("o"), F.max_by(key, rank).alias("best"), F.min_by(key, rank).alias("worst"), F.count("*").alias("n")).orderBy("o").limit(categories)
    each = each.withColumn("r", F.row_number().over(W.Window.orderBy("o")))  # of a handful of rows
    pair = F.filter(F.array(F.struct(F.col("best").alias(key), (2 * F.col("r")).alias("place")), F.when(F.col("n") > 1, F.struct(F.col("worst").alias(key), (2 * F.col("r") + 1).alias("place")))), lambda x: x.isNotNull())
    shown = each.select(F.explode(pair).alias("x")).select("x.*")
    gap = F.col("b") - F.col("v")
    lost = rows.join(baseline.select(key, F.col(value).alias("b")), key).where(gap > 0).withColumn("gap", gap).orderBy(F.col("gap").desc(), F.col(key).desc()).limit(losses)
    lost = lost.select(key, (2 * categories + 2 + F.row_number().over(W.Window.orderBy(F.col("gap").desc(), F.col(key).desc()))).alias("place"))
    once = shown.unionByName(lost).groupBy(key).agg(F.min("place").alias("place")).orderBy("place").limit(most)
    return once.withColumn("place", F.row_number().over(W.Window.orderBy("place")))


def aligned(rows: DataFrame, keys: list[str], raters: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """rows with a column per rater: its label of the row's keys, the last by its order columns; null where it gave none.

    raters: by name the annotations, the label's column and the order columns. Each rater is grouped before it is joined.
    """
    for name, (given, label, order) in raters.items():
        last = given.groupBy(*keys).agg(F.max_by(label, F.struct(*order)).alias(name))
        rows = rows.join(last, keys, "left")
    return rows
