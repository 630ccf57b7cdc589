"""Spans within texts: paragraphs with offsets, containment of one span in another, and samples of annotated paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BLANK_LINE = re.compile(r"\n\s*\n")
# Risk of an identifier's type. Fixed values.
IDENTIFIER_RISK = {"DIRECT": 0.85, "QUASI": 0.65, "NO_MASK": 0.45}
OTHER_RISK = 0.5


def paragraphs(rows: DataFrame, key: str, text: str, least: int = 30) -> DataFrame:
    """(key, paragraph, start, end, text): parts between blank lines with at least least characters when stripped.

    paragraph numbers those that stay; start and end are those of the part before stripping, in characters. Null texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                begin, n = 0, 0
                for stop, after in [*((m.start(), m.end()) for m in _BLANK_LINE.finditer(t or "")), (len(t or ""), 0)]:
                    part = (t or "")[begin:stop].strip()
                    if len(part) >= least:
                        at.append(i)
                        out.append((n, begin, stop, part))
                        n += 1
                    begin = after
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True))], names=[key, "paragraph", "start", "end", "text"])

    given = rows.select(key, F.col(text).cast("string"))
    return given.mapInArrow(run, StructType([*given.select(key).schema.fields, *StructType.fromDDL("paragraph int, start int, end int, text string").fields]))


def contained(inner: DataFrame, outer: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """outer joined to the rows of inner that lie within it whole: equal key, outer's start and end around inner's.

    Both have key, start and end; inner's are named inner_start and inner_end in the result. Spans
    meet by bins of width characters: an outer span is in all its bins, an inner one in that of its start, so
    a long text's spans do not all meet each other.
    """
    i = inner.withColumnsRenamed({"start": "inner_start", "end": "inner_end"}).withColumn("_bin", F.floor(F.col("inner_start") / width))
    o = outer.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    met = o.join(i, [key, "_bin"]).where((F.col("inner_start") >= F.col("start")) & (F.col("inner_end") <= F.col("end")))
    return met.drop("_bin")


def identifier_risk(kind: Column) -> Column:
    out = F.lit(OTHER_RISK)
    for k, v in IDENTIFIER_RISK.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def annotated_paragraphs(docs: DataFrame, entities: DataFrame, key: str, text: str, least: int = 30, most_chars: int = 600, min_entities: int = 1) -> DataFrame:
    """(key, paragraph, text, category, risk_score, sensitive_fields) of the paragraphs that hold entities.

    entities: key, start, end, span_text, entity_type and identifier_type (null: MISC and NO_MASK). risk_score is the greatest
    risk of an identifier type, category the different entity types, sorted and joined by bars; sensitive_fields
    are the spans of two characters or more, by place. Paragraphs with less than min_entities or without such a span are left
    out; texts are cut at most_chars.
    """
    e = entities.select(key, "start", "end", "span_text", F.coalesce("entity_type", F.lit("MISC")).alias("entity_type"), F.coalesce("identifier_type", F.lit("NO_MASK")).alias("identifier_type"))
    met = contained(e, paragraphs(docs, key, text, least).withColumnRenamed("text", "_text"), key)
    found = met.groupBy(key, "paragraph").agg(
        F.first("_text").alias("text"),
        F.array_join(F.array_sort(F.collect_set("entity_type")), "|").alias("category"),
        F.max(identifier_risk(F.col("identifier_type"))).alias("risk_score"),
        F.transform(F.array_sort(F.collect_list(F.when(F.length("span_text") >= 2, F.struct("inner_start", "inner_end", "span_text")))), lambda s: s["span_text"]).alias("sensitive_fields"),
        F.count("*").alias("n"),
    )
    return found.where((F.col("n") >= min_entities) & (F.size("sensitive_fields") > 0)).select(key, "paragraph", F.left("text", F.lit(most_chars)).alias("text"), "category", "risk_score", "sensitive_fields")
