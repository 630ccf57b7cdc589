"""Model features and synthetic behaviours: encoders, the evidential head, labelled variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X


def _index(item: Column, vocab: list[str]) -> Column:
    """Place of an item: exact, else without case, else the first term that the item contains; null for none."""

    def place(x: Column) -> Column:
        low = F.lower(x)
        exact = F.array_position(F.array(*map(F.lit, vocab)), x)
        near = F.array_position(F.array(*[F.lit(v.lower()) for v in vocab]), low)
        inside = F.coalesce(*[F.when(F.contains(low, F.lit(v.lower())), F.lit(k)) for k, v in enumerate(vocab)])
        return F.when(exact > 0, (exact - 1).cast("int")).when(near > 0, (near - 1).cast("int")).otherwise(inside)

    return X.let(F.trim(item), place)


def multi_hot(items: Column, vocab: list[str]) -> Column:
    found = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda i: _index(i, vocab))
    return X.let(found, lambda f: F.array(*[F.when(F.array_contains(f, k), 1.0).otherwise(0.0) for k in range(len(vocab))]))


def behaviour_vector(categories: Column, actions: Column, purposes: Column) -> Column:
    return F.concat(multi_hot(categories, T.VOCAB_DATA), multi_hot(actions, T.VOCAB_ACTIONS), multi_hot(purposes, T.VOCAB_PURPOSES))


def behaviour_text(categories: Column, actions: Column, purposes: Column, raw: Column | None = None) -> Column:
    part = lambda name, a: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{name}: "), F.array_join(a, ", "), F.lit(".")))
    built = F.concat_ws(" ", part("Data", categories), part("Actions", actions), part("Purposes", purposes))
    out = F.when(built == "", "empty").otherwise(built)
    return F.when(F.coalesce(raw, F.lit("")) != "", raw).otherwise(out) if raw is not None else out


def softplus(x: Column) -> Column:
    return F.when(x > 20, x).otherwise(F.log1p(F.exp(x)))


def evidential(logit0: Column, logit1: Column) -> tuple[Column, Column]:
    """(risk, uncertainty) of the evidential head: alpha = softplus + 1, risk alpha_1 / S, uncertainty 2 / S."""
    a0, a1 = softplus(logit0) + 1, softplus(logit1) + 1
    return a1 / (a0 + a1), 2 / (a0 + a1)


def dense(x: Column, weights: list[list[float]], bias: list[float], relu: bool) -> Column:
    """One linear layer over an array column, for small nets with fixed weights."""
    rows = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + b for w, b in zip(weights, bias, strict=True)]
    return F.array(*[F.greatest(r, F.lit(0.0)) if relu else r for r in rows])


def target_label(decision: Column) -> Column:
    d = F.lower(decision)
    return F.when(d == "allow", 0).when(d.isin("deny", "transform"), 1)


def behaviours(statements: DataFrame) -> DataFrame:
    """Three behaviours per valid statement: compliant (as stated), violating (a foreign category) and ambiguous (no purpose).

    The foreign category is the one at md5(id) among the vocabulary without the statement's own.
    """
    own = F.coalesce("data_categories", F.array().cast("array<string>"))
    valid = statements.where((F.size(own) > 0) | (F.size(F.coalesce("actions", F.array().cast("array<string>"))) > 0))
    foreign = F.array_except(F.array(*map(F.lit, T.VOCAB_DATA)), own)
    h = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    pick = F.array(F.get(foreign, (h % F.size(foreign)).cast("int")))
    kinds = F.array(
        F.struct(F.lit("compliant").alias("kind"), own.alias("data_categories"), F.col("purposes").alias("purposes")),
        F.struct(F.lit("violating").alias("kind"), F.concat(pick, F.slice(own, 1, 1)).alias("data_categories"), F.array(F.lit("Unknown")).alias("purposes")),
        F.struct(F.lit("ambiguous").alias("kind"), F.slice(own, 1, 1).alias("data_categories"), F.array().cast("array<string>").alias("purposes")),
    )
    return valid.select("id", F.explode(kinds).alias("b")).select(F.col("id").alias("statement_id"), "b.*")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0: eight steps up, then Stirling's series."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * F.pow(z, F.lit(5.0)))
    down = F.log(x)
    for k in range(1, 8):
        down = down + F.log(x + float(k))
    return series - down


def digamma(x: Column) -> Column:
    """The derivative of log_gamma: eight steps up, then its asymptotic series."""
    z = x + 8.0
    y = F.log(z) - 1.0 / (2.0 * z) - 1.0 / (12.0 * z * z) + 1.0 / (120.0 * F.pow(z, F.lit(4.0))) - 1.0 / (252.0 * F.pow(z, F.lit(6.0)))
    for k in range(8):
        y = y - 1.0 / (x + float(k))
    return y


def evidential_loss(alpha0: Column, alpha1: Column, label: Column, epoch: Column) -> Column:
    """Squared error plus variance of the expected probabilities, and min(1, epoch / 10) times the divergence from the uniform Dirichlet of what speaks against the label."""
    s = alpha0 + alpha1
    y1 = label.cast("double")
    y0 = 1.0 - y1
    fit = F.pow(y0 - alpha0 / s, F.lit(2.0)) + F.pow(y1 - alpha1 / s, F.lit(2.0)) + (alpha0 * (s - alpha0) + alpha1 * (s - alpha1)) / (s * s * (s + 1.0))
    b0, b1 = y0 + (1.0 - y0) * alpha0, y1 + (1.0 - y1) * alpha1
    t = b0 + b1
    kl = log_gamma(t) - log_gamma(b0) - log_gamma(b1) + (b0 - 1.0) * (digamma(b0) - digamma(t)) + (b1 - 1.0) * (digamma(b1) - digamma(t))
    return fit + F.least(F.lit(1.0), epoch / 10.0) * kl


def encoded(rows: DataFrame, text: str, vector: str, factory) -> DataFrame:
    """rows with a client's vector of the column text; different texts are encoded once, told apart by md5.

    factory makes the client, a function from a list of texts to a list of vectors, once per worker.
    """
    import pandas as pd

    key = "_text_md5"
    while key in rows.columns:
        key = f"_{key}"

    def run(batches):
        encode = factory()
        for b in batches:
            yield pd.DataFrame({key: b[key], vector: list(encode(b["t"].tolist()))})

    keyed = rows.withColumn(key, F.md5(F.coalesce(F.col(text), F.lit(""))))
    once = keyed.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates([key]).mapInPandas(run, f"{key} string, {vector} array<double>")
    return keyed.join(once, key).select(*rows.columns, vector)
