"""Queries of evaluation metrics, over outcomes derived from the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..catalog import query
from ..operators import inversions
from ..operators import metrics as M
from ..sources import readers
from .inputs import ctes, frame, table

O = ctes("outcomes")
LABELS = ["allow", "deny", "transform"]


def _rows(spark, sf):
    return frame(spark, sf, "outcomes")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("ag01_distribution", f"{O} SELECT gold_label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM outcomes_in GROUP BY 1")
def ag01(spark, sf):
    n = _rows(spark, sf).groupBy("gold_label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.Window.partitionBy(F.lit(1))), 6))


@query("ag02_mean_std", f"{O} SELECT unit, count(*) AS n, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std FROM outcomes_in GROUP BY 1")
def ag02(spark, sf):
    return _rounded(_rows(spark, sf).groupBy("unit").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std")), "mean", "std")


@query("ag03_metric_cube", f"{O}, l AS (SELECT grp, unit % 4 AS seed, metric, value FROM outcomes_in UNPIVOT (value FOR metric IN (x, y, z))), p AS (SELECT grp, seed, metric, avg(value) AS v FROM l GROUP BY ALL) SELECT grp, metric, count(*) AS n_seeds, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM p GROUP BY ROLLUP (grp, metric)")
def ag03(spark, sf):
    """Mean and spread over seeds of each metric and group, with totals."""
    l = _rows(spark, sf).unpivot(["grp", "unit"], ["x", "y", "z"], "metric", "value")
    p = l.groupBy("grp", (F.col("unit") % 4).alias("seed"), "metric").agg(F.avg("value").alias("v"))
    return _rounded(p.rollup("grp", "metric").agg(F.count("*").alias("n_seeds"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std")), "mean", "std")


@query("ag05_pivot", f"{O} SELECT grp, round(avg(x) FILTER (gold_label = 'allow'), 6) AS allow, round(avg(x) FILTER (gold_label = 'deny'), 6) AS deny, round(avg(x) FILTER (gold_label = 'transform'), 6) AS transform FROM outcomes_in GROUP BY 1")
def ag05(spark, sf):
    return _rounded(_rows(spark, sf).groupBy("grp").pivot("gold_label", LABELS).agg(F.avg("x")), *LABELS)


@query("ag06_confusion", f"{O}, l AS (SELECT unnest(['allow', 'deny', 'transform', 'ask']) AS v) SELECT g.v AS gold, p.v AS pred, count(o.key) AS n FROM l g CROSS JOIN l p LEFT JOIN outcomes_in o ON o.gold_label = g.v AND o.pred_label = p.v GROUP BY ALL")
def ag06(spark, sf):
    return M.confusion(_rows(spark, sf), "gold_label", "pred_label", [*LABELS, "ask"])


@query("ag07_binary", f"{O}, c AS (SELECT count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 1) AS fp, count(*) FILTER (gold = 1 AND pred = 0) AS fn, count(*) FILTER (gold = 0 AND pred = 0) AS tn FROM outcomes_in), r AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS q FROM c) SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / greatest(1e-9, p + q), 6) AS f1, round((tp + tn) / greatest(1, tp + fp + fn + tn), 6) AS accuracy FROM r")
def ag07(spark, sf):
    return _rounded(M.binary(_rows(spark, sf), "gold", "pred"), "precision", "recall", "f1", "accuracy")


_PC = f"{O}, l AS (SELECT unnest(['allow', 'deny', 'transform', 'ask']) AS label), c AS (SELECT label, count(*) FILTER (gold_label = label AND pred_label = label) AS tp, count(*) FILTER (gold_label <> label AND pred_label = label) AS fp, count(*) FILTER (gold_label = label AND pred_label <> label) AS fn FROM l CROSS JOIN outcomes_in GROUP BY 1), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q FROM c), f AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END AS f FROM r)"


@query("ag08_per_class", f"{_PC} SELECT label, tp, fp, fn, tp + fn AS support, round(p, 6)::DOUBLE AS precision, round(q, 6)::DOUBLE AS recall, round(f, 6)::DOUBLE AS f1 FROM f")
def ag08(spark, sf):
    return _rounded(M.per_class(_rows(spark, sf), "gold_label", "pred_label", [*LABELS, "ask"]), "precision", "recall", "f1")


@query("ag11_macro_f1", f"{_PC} SELECT round(avg(f), 6) AS macro_f1 FROM f WHERE label <> 'ask'")
def ag11(spark, sf):
    return M.per_class(_rows(spark, sf), "gold_label", "pred_label").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


@query("ag12_agreement", f"{O} SELECT gold_label AS band, round(avg((gold_label = pred_label)::INT), 6) AS agreement FROM outcomes_in GROUP BY 1")
def ag12(spark, sf):
    return _rows(spark, sf).groupBy(F.col("gold_label").alias("band")).agg(F.round(F.avg((F.col("gold_label") == F.col("pred_label")).cast("int")), 6).alias("agreement"))


_RANKS = f"{O}, r AS (SELECT unit, key, rank() OVER (PARTITION BY unit ORDER BY x) + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY unit ORDER BY y) + (count(*) OVER (PARTITION BY unit, y) - 1) / 2.0::DOUBLE AS ry FROM outcomes_in)"


@query("wn02_average_ranks", f"{_RANKS} SELECT key, rx FROM r")
def wn02(spark, sf):
    return M.average_ranks(_rows(spark, sf), "x", ["unit"], "rx").select("key", "rx")


_RHO = f"{_RANKS}, d AS (SELECT unit, count(*) AS n, sum(pow(rx - ry, 2)) AS d2 FROM r GROUP BY 1), rho AS (SELECT unit, n, CASE WHEN n < 2 THEN 0.0 ELSE 1 - 6 * d2 / (n::DOUBLE * (n::DOUBLE * n - 1)) END AS rho FROM d)"


@query("ag13_spearman", f"{_RHO} SELECT unit, n, round(rho, 6)::DOUBLE AS rho FROM rho")
def ag13(spark, sf):
    return _rounded(M.spearman(_rows(spark, sf), "x", "y", ["unit"]), "rho")


@query("ag14_pearson", f"{O} SELECT grp, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS r FROM outcomes_in GROUP BY 1")
def ag14(spark, sf):
    return _rounded(M.pearson(_rows(spark, sf), "x", "y", ["grp"]), "r")


@query("ag15_kendall", f"{O}, o AS (SELECT *, row_number() OVER () AS i FROM outcomes_in), p AS (SELECT a.unit, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM o a JOIN o b ON a.unit = b.unit AND a.i < b.i), c AS (SELECT unit, count(*) FILTER (s > 0) AS c, count(*) FILTER (s < 0) AS d, count(*) FILTER (tx) AS tx, count(*) FILTER (ty) AS ty, count(*) AS n FROM p GROUP BY 1) SELECT unit, round(CASE WHEN (n - tx) * (n - ty) = 0 THEN 0.0 ELSE (c - d) / sqrt((n - tx)::DOUBLE * (n - ty)) END, 6)::DOUBLE AS tau FROM c")
def ag15(spark, sf):
    return _rounded(inversions.kendall(_rows(spark, sf), "key", "x", "y", ["unit"]), "tau")


@query("ag16_errors", f"{O} SELECT grp, round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse FROM outcomes_in GROUP BY 1")
def ag16(spark, sf):
    return _rounded(M.errors(_rows(spark, sf), "x", "y", ["grp"]), "mae", "rmse")


_BINS = f"{O}, b AS (SELECT least(floor(x * 10), 9)::BIGINT AS bin, count(*) AS n, avg(x) AS confidence, avg((gold = pred)::INT::DOUBLE) AS accuracy FROM outcomes_in GROUP BY 1)"


@query("ag17_reliability", f"{_BINS} SELECT bin, n, round(confidence, 3) AS confidence, round(accuracy, 3) AS accuracy FROM b")
def ag17(spark, sf):
    b = M.calibration(_rows(spark, sf), F.col("x"), F.col("gold") == F.col("pred"))
    return b.withColumns({"confidence": F.round("confidence", 3), "accuracy": F.round("accuracy", 3)})


@query("ag17_ece", f"{_BINS} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM b")
def ag17_ece(spark, sf):
    return _rounded(M.ece(M.calibration(_rows(spark, sf), F.col("x"), F.col("gold") == F.col("pred"))), "ece")


@query("ag18_brier", f"{O} SELECT grp, round(avg(pow(x - gold, 2)), 6) AS brier, round(avg((y >= 0.25)::INT), 6) AS escalated FROM outcomes_in GROUP BY 1")
def ag18(spark, sf):
    return _rows(spark, sf).groupBy("grp").agg(F.round(F.avg(F.pow(F.col("x") - F.col("gold"), 2)), 6).alias("brier"), F.round(F.avg((F.col("y") >= 0.25).cast("int")), 6).alias("escalated"))


@query("ag20_wilson", f"{O}, c AS (SELECT unit, count(*)::DOUBLE AS n, sum(gold)::DOUBLE AS k FROM outcomes_in GROUP BY 1), p AS (SELECT *, k / n AS p, 1 + 3.8416 / n AS den, (k / n + 3.8416 / (2 * n)) AS mid, 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) AS half FROM c) SELECT unit, round(greatest(0.0, mid / den - half / den), 6)::DOUBLE AS lo, round(least(1.0, mid / den + half / den), 6)::DOUBLE AS hi FROM p")
def ag20(spark, sf):
    c = _rows(spark, sf).groupBy("unit").agg(F.count("*").alias("n"), F.sum("gold").alias("k"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return c.select("unit", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("ag21_fisher", f"{_RHO}, z AS (SELECT unit, 0.5 * ln((1 + rho) / (1 - rho)) AS z, 1.96 / sqrt((n - 3)::DOUBLE) AS h FROM rho WHERE rho > -1 AND rho < 1 AND n > 3) SELECT rho.unit, round((exp(2 * (z - h)) - 1) / (exp(2 * (z - h)) + 1), 6) AS lo, round((exp(2 * (z + h)) - 1) / (exp(2 * (z + h)) + 1), 6) AS hi FROM rho LEFT JOIN z USING (unit)")
def ag21(spark, sf):
    s = M.spearman(_rows(spark, sf), "x", "y", ["unit"])
    lo, hi = M.fisher(F.col("rho"), F.col("n"))
    return s.select("unit", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_B = 200
_DRAW = ctes("draws") + f", n AS (SELECT grp, count(*) AS n FROM draws_in GROUP BY 1), s AS (SELECT grp, b, ('0x' || left(md5('42|' || b || '|' || i), 8))::BIGINT % n AS i FROM draws_in JOIN n USING (grp) CROSS JOIN range({_B}) t(b)), m AS (SELECT grp, b, avg(v) AS mv, avg(d) AS md FROM s JOIN draws_in USING (grp, i) GROUP BY ALL)"


@query("ag22_bootstrap", f"{_DRAW}, r AS (SELECT grp, round(mv, 9) AS m, row_number() OVER (PARTITION BY grp ORDER BY round(mv, 9)) - 1 AS r FROM m) SELECT grp, round(avg(m), 5) AS mean, round(max(m) FILTER (r = 5), 5) AS lo, round(max(m) FILTER (r = 195), 5) AS hi FROM r GROUP BY 1")
def ag22(spark, sf):
    b = M.bootstrap_mean(frame(spark, sf, "draws"), "v", ["grp"], _B)
    return b.withColumns({c: F.round(c, 5) for c in ("mean", "lo", "hi")})


@query("ag23_paired_bootstrap", f"{_DRAW}, a AS (SELECT grp, avg(d) AS mean_diff FROM draws_in GROUP BY 1) SELECT grp, round(mean_diff, 6) AS mean_diff, round(least(1.0, 2 * least(avg((round(md, 9) <= 0)::INT), avg((round(md, 9) >= 0)::INT))), 6)::DOUBLE AS p_sign, round(CASE WHEN mean_diff = 0 THEN 1.0 ELSE avg((round(abs(md - mean_diff), 9) >= round(abs(mean_diff), 9))::INT) END, 6)::DOUBLE AS p_centred FROM m JOIN a USING (grp) GROUP BY grp, mean_diff")
def ag23(spark, sf):
    return _rounded(M.paired_bootstrap(frame(spark, sf, "draws"), "d", ["grp"], _B), "mean_diff", "p_sign", "p_centred")


@query("ag25_krippendorff", f"{O}, u AS (SELECT grp, unit, count(*) AS m FROM outcomes_in GROUP BY ALL HAVING count(*) > 1), r AS (SELECT o.grp, o.unit, o.key, o.x, u.m FROM outcomes_in o JOIN u USING (grp, unit)), d AS (SELECT a.grp, sum(pow(a.x - b.x, 2) / (a.m - 1)) AS observed FROM r a JOIN r b ON a.grp = b.grp AND a.unit = b.unit GROUP BY 1), e AS (SELECT grp, count(*) AS n, 2 * (count(*) * sum(x * x) - pow(sum(x), 2)) / (count(*) - 1) AS expected FROM r GROUP BY 1) SELECT grp, round(1 - observed / expected, 6) AS alpha FROM d JOIN e USING (grp)")
def ag25(spark, sf):
    return _rounded(M.krippendorff(_rows(spark, sf), "unit", "x", ["grp"]), "alpha")


@query("ag27_majority", f"{O}, c AS (SELECT unit, gold_label, count(*) AS votes FROM outcomes_in GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY votes DESC, gold_label) AS r FROM c) SELECT unit, CASE WHEN votes >= 2 THEN gold_label END AS gold_label, votes FROM r WHERE r = 1")
def ag27(spark, sf):
    return M.majority(_rows(spark, sf), ["unit"], "gold_label", 2)


@query("ag30_telemetry", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def ag30(spark, sf):
    """An extension: the usage table that it summarises is declared but never read in the original."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("ag31_cache_stats", "SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) AS total, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS rate FROM events GROUP BY 1")
def ag31(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count("*").alias("total"))
    return e.withColumn("rate", F.round(F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)), 6))


@query("jn06_paired", f"{O} SELECT a.key, a.x - b.x AS diff FROM outcomes_in a JOIN outcomes_in b ON a.unit = b.unit AND a.key + 1 = b.key")
def jn06(spark, sf):
    r = _rows(spark, sf)
    b = r.select("unit", (F.col("key") - 1).alias("key"), F.col("x").alias("xb"))
    return r.join(b, ["unit", "key"]).select("key", (F.col("x") - F.col("xb")).alias("diff"))


@query("wn05_holm", "WITH t AS (SELECT n_nationkey AS k, 0.0005 * (1 + n_nationkey * 7 % 25) AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS n FROM t), f AS (SELECT *, max((p > 0.05 / (n - r + 1))::INT) OVER (ORDER BY p, k) AS f FROM r) SELECT k, f = 0 AS significant FROM f")
def wn05(spark, sf):
    t = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (0.0005 * (1 + F.col("n_nationkey") * 7 % 25)).alias("p"))
    return M.holm(t, "p", "k").select("k", "significant")


@query("wn06_pareto", f"{O}, b AS (SELECT *, max(y) OVER (PARTITION BY unit ORDER BY x DESC, y DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM outcomes_in) SELECT key FROM b WHERE y > coalesce(b, -1)")
def wn06(spark, sf):
    return M.pareto(_rows(spark, sf), "y", "x", ["unit"], "key").select("key")


@query("wn07_best_worst", f"{O}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY x DESC, key) AS b, row_number() OVER (PARTITION BY unit ORDER BY x, key) AS w FROM outcomes_in) SELECT unit, key, 'best' AS which FROM r WHERE b = 1 UNION ALL SELECT unit, key, 'worst' FROM r WHERE w = 1")
def wn07(spark, sf):
    return readers.best_and_worst(_rows(spark, sf), "unit", "x", "key")


_OURS = "o AS (SELECT c_custkey AS sample_id, c_mktsegment || '|' || c_nationkey AS category, round(c_acctbal) AS privacy FROM customer), b AS (SELECT c_custkey AS sample_id, (c_custkey * 37 % 1000) * 10.0 AS privacy FROM customer)"


@query(
    "wn07_examples",
    f"""WITH {_OURS}, r AS (SELECT *, string_split(category, '|')[1] AS c FROM o),
    k AS (SELECT c, row_number() OVER (ORDER BY min(sample_id)) AS k, count(*) AS n FROM r GROUP BY c),
    x AS (SELECT r.*, k, n, row_number() OVER (PARTITION BY c ORDER BY privacy DESC, sample_id) AS best, row_number() OVER (PARTITION BY c ORDER BY privacy, sample_id DESC) AS worst FROM r JOIN k USING (c) WHERE k <= 5),
    s AS (SELECT sample_id, 2 * k AS place FROM x WHERE best = 1 UNION ALL SELECT sample_id, 2 * k + 1 FROM x WHERE worst = 1 AND n > 1
      UNION ALL SELECT sample_id, 12 + row_number() OVER (ORDER BY gap DESC, sample_id DESC) FROM (SELECT sample_id, b.privacy - o.privacy AS gap FROM o JOIN b USING (sample_id) WHERE b.privacy > o.privacy ORDER BY gap DESC, sample_id DESC LIMIT 2)),
    d AS (SELECT sample_id, min(place) AS place FROM s GROUP BY 1)
    SELECT sample_id, row_number() OVER (ORDER BY place) AS place FROM d ORDER BY place LIMIT 10""",
)
def wn07_examples(spark, sf):
    """Customers to show: a report of at most ten, over all of them."""
    c = table(spark, sf, "customer")
    ours = c.select(F.col("c_custkey").alias("sample_id"), F.concat_ws("|", "c_mktsegment", "c_nationkey").alias("category"), F.round("c_acctbal").alias("privacy"))
    baseline = c.select(F.col("c_custkey").alias("sample_id"), (F.col("c_custkey") * 37 % 1000 * 10.0).alias("privacy"))
    return M.examples(ours, baseline, "sample_id", "category", "privacy", "sample_id")


_LINES = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "jn10_aligned_raters",
    "WITH a AS (SELECT l_orderkey, " + ", ".join(f"max({{'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice, 'l': {x}}}) FILTER ({t}).l AS {n}" for n, x, t in (("first", "l_returnflag", "l_quantity > 30"), ("second", "l_linestatus", "l_discount > 0.06"), ("third", "l_returnflag || l_linestatus", "l_tax < 0.02"))) + " FROM lineitem GROUP BY 1) SELECT o_orderkey, first, second, third FROM orders LEFT JOIN a ON o_orderkey = l_orderkey",
)
def jn10_raters(spark, sf):
    """Each order with what three raters said last; lines that pass a rater's test are its annotations."""
    line = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").withColumn("both", F.concat("l_returnflag", "l_linestatus"))
    raters = {"first": (line.where("l_quantity > 30"), "l_returnflag", [*_LINES]), "second": (line.where("l_discount > 0.06"), "l_linestatus", [*_LINES]), "third": (line.where("l_tax < 0.02"), "both", [*_LINES])}
    return M.aligned(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], raters)


@query("wn09_batches", "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS batch, event_id FROM events")
def wn09(spark, sf):
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", F.floor((F.row_number().over(w) - 1) / 20).alias("batch"), "event_id")
