"""Calls of a model with retries, and a log of answers that survives lost executors and drivers.

Each different prompt is asked once per attempt until it has an answer. Prompts are moved and written once, whatever the
attempts, and go when all are answered. They are asked in slices, of which there are at most
MOST_SLICES and each reads its own prompts only, so that an attempt's work is in proportion to them;
each slice's answers are appended to the log by a write job of its own, whose tasks commit one by
one, so what was answered before an executor or the driver was lost is not asked again: a new call with the same log goes on from it.
Between attempts the driver waits, longer each time; no executor waits.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

LOG = "key string, attempt int, answer string, error string, seconds double"
#: What is not asked again: the client refuses, or cannot read the prompt.
FINAL = ("PermissionError", "ValueError")
INVALID = "InvalidAnswer"
#: More prompts than these slices hold make each of them larger.
MOST_SLICES = 32
#: Rows that a task of the join of rows and answers should have.
JOINED = 10_000
#: Keys of a slice that are sent to all tasks, so that its prompts need not move; of more, both move.
SENT_KEYS = 250_000


def key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The log's rows; none where there is no log yet."""
    return spark.read.schema(LOG).parquet(log) if _is_there(spark, log) else spark.createDataFrame([], LOG)


def _is_there(spark: SparkSession, log: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def outcomes(log: DataFrame) -> DataFrame:
    """key, answer, error, attempts and seconds (of all attempts) of each prompt: its first answer, else its last error."""
    first = F.min(F.when(F.col("answer").isNotNull(), F.struct("attempt", "answer")))
    last = F.max(F.struct("attempt", "error"))
    return log.groupBy("key").agg(first["answer"].alias("answer"), F.when(first.isNull(), last["error"]).alias("error"), F.max("attempt").alias("attempts"), F.sum("seconds").alias("seconds"))


def _asking(factory: Callable[[int], Callable[[str], str]], attempt: int):
    def run(batches: Iterator[pa.RecordBatch]):
        client = factory(attempt)
        for batch in batches:
            keys, answers, errors, took = [], [], [], []
            for k, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                began, answer, error = time.perf_counter(), None, None
                try:
                    answer = client(prompt)
                    error = None if isinstance(answer, str) else INVALID
                except Exception as e:  # noqa: BLE001  whatever a client raises is that prompt's error
                    error = type(e).__name__
                keys.append(k)
                answers.append(answer if error is None else None)
                errors.append(error)
                took.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([attempt] * len(keys), pa.int32()), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(took, pa.float64())], names=[c.split()[0] for c in LOG.split(", ")])

    return run


def ask(rows: DataFrame, prompt: str, factory: Callable[[int], Callable[[str], str]], log: str, attempts: int = 8, base: float = 2.0, longest: float = 60.0, slice_rows: int = 10_000, valid: Callable[[Column], Column] | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows with answer, error and attempts of the column prompt (null for a null prompt).

    factory makes the client of an attempt, once per task; it may raise, and the name of
    what it raises is the error. An answer that is not valid is the error INVALID. Errors
    but those in FINAL are asked again, at most attempts times, after min(longest, base ** attempt) seconds.
    """
    spark = rows.sparkSession
    n_rows, n = rows.agg(F.count("*"), F.count(prompt)).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // JOINED))
    slices = min(max(1, -(-n // slice_rows)), MOST_SLICES)
    prompts = rows.select(key(F.col(prompt)).alias("key"), F.col(prompt).alias("prompt")).where(F.col("prompt").isNotNull())
    # dealt by key, so that the copies of a prompt are in one task and move once
    where = shared.path(spark, "prompts")
    wanted = prompts.repartition(parts, "key").distinct().withColumn("_slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))
    wanted = shared.written(wanted, where, "_slice")
    written = [where]
    for attempt in range(1, attempts + 1):
        if _is_there(spark, log):
            seen = outcomes(read_log(spark, log))
            settled = seen.where(F.col("answer").isNotNull() | F.col("error").isin(*FINAL) | (F.col("attempts") >= attempt)).select("key")
            written.append(shared.path(spark, "left"))
            left = shared.written(wanted.select("key", "_slice").join(settled, "key", "left_anti"), written[-1])
            n = left.count()
            open_ = n or wanted.select("key").join(seen.where(F.col("answer").isNotNull() | F.col("error").isin(*FINAL)).select("key"), "key", "left_anti").limit(1).count()
        else:
            left, n = None, wanted.count()
            open_ = n
        if not open_:
            break
        if not n:
            continue  # a log that has this attempt already
        if attempt > 1:
            wait(min(longest, base ** (attempt - 1)))
        turns = min(-(-n // slice_rows), slices)
        for k in range(turns):
            turn = F.pmod(F.col("_slice"), F.lit(turns)) == k
            some = wanted.where(turn).select("key", "prompt")
            if left is not None:
                keys = left.where(turn).select("key")
                some = some.join(F.broadcast(keys) if n <= turns * SENT_KEYS else keys, "key", "left_semi")
            got = some.mapInArrow(_asking(factory, attempt), LOG)
            if valid is not None:
                ok = F.col("answer").isNull() | F.coalesce(valid(F.col("answer")), F.lit(False))
                got = got.withColumns({"error": F.when(ok, F.col("error")).otherwise(INVALID), "answer": F.when(ok, F.col("answer"))})
            got.write.mode("append").parquet(log)
    for w in written:
        shared.drop(spark, w)
    found = outcomes(read_log(spark, log)).select(F.col("key").alias("_key"), "answer", "error", "attempts")
    # rows without a prompt are spread by their values, since all nulls would meet in one task
    plain = [F.col(f.name) for f in rows.schema if "map<" not in f.dataType.simpleString()]
    to = F.when(F.col(prompt).isNotNull(), key(F.col(prompt))).otherwise(F.concat(F.lit("-"), F.xxhash64(*plain).cast("string")))
    return rows.withColumn("_to", to).repartition(parts, "_to").join(found, F.col("_to") == F.col("_key"), "left").drop("_to", "_key")


def unfenced(answer: Column) -> Column:
    """The answer without thinking blocks and without the fence around it."""
    x = F.trim(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""))
    return F.trim(F.regexp_replace(x, r"(?s)^`+[^\n{]*\n?|`+\s*$", ""))


RATED = ("privacy", "utility", "fluency")


def rated(answer: Column) -> Column:
    """struct of three whole ratings, cut to 1 to 5, a missing one 1; null for what is not a JSON object or has a rating that is no number."""
    text = unfenced(answer)
    fields = [F.get_json_object(text, f"$.{k}") for k in RATED]
    numbers = [F.coalesce(f, F.lit("0")).try_cast("double") for f in fields]
    ok = F.from_json(text, "map<string,string>").isNotNull()
    for x in numbers:
        ok = ok & x.isNotNull()
    return F.when(ok, F.struct(*(F.greatest(F.lit(1), F.least(F.lit(5), x.cast("int"))).alias(k) for k, x in zip(RATED, numbers, strict=True))))


def likelihood(answer: Column) -> Column:
    """The field likelihood of an answer; 0.5 where it is missing, no number or unreadable."""
    return F.coalesce(F.get_json_object(unfenced(answer), "$.likelihood").try_cast("double"), F.lit(0.5))
