"""Readers and writers of policy corpora, feedback and audit logs; every schema is declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import tables as T
from ..functions import text as X

ANNOTATION = "c0 string, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string, c7 string, c8 string"
CATEGORIES = ("First Party Collection/Use", "Third Party Sharing/Collection", "User Choice/Control", "User Access, Edit and Deletion", "Data Retention", "Data Security", "Policy Change", "Do Not Track", "International and Specific Audiences", "Other")
FEEDBACK = "ts double, timestamp string, behavior struct<data_categories:array<string>,actions:array<string>,purposes:array<string>,raw_text:string>, policy struct<data_categories:array<string>,actions:array<string>,purposes:array<string>,raw_text:string>, sys1_uncertainty double, sys1_prediction double, teacher_decision string, target_label int, rationale string"
SQUAD = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,type:string>>>>>>"
BEHAVIOUR = "domain string, behavior struct<data_categories:array<string>,actions:array<string>,purposes:array<string>>, policy struct<data_categories:array<string>,actions:array<string>,purposes:array<string>>, generation_type string, statement_id long, source string"
SYNTH = "personality map<string,string>, feature string, hardness int, question_asked string, response string, guess string"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(policy, annotation_id, segment, category, attribute, value, text) of header-less annotation CSVs.

    Rows of unknown categories or without integer ids are left out; a broken JSON
    gives no attribute. Of each attribute the not-selected values are dropped.
    """
    raw = spark.read.schema(ANNOTATION).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    x = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.csv$", 1).alias("policy"), F.expr("try_cast(c0 as int)").alias("annotation_id"), F.expr("try_cast(c4 as int)").alias("segment"), F.col("c5").alias("category"), F.from_json("c6", "map<string,struct<value:string,selectedText:string>>").alias("attributes"))
    x = x.where(F.col("annotation_id").isNotNull() & F.col("segment").isNotNull() & F.col("category").isin(*CATEGORIES))
    kept = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,struct<value:string,selectedText:string>>")), lambda k, v: F.coalesce(F.lower(v["value"]), F.lit("not-selected")) != "not-selected")
    return x.select("policy", "annotation_id", "segment", "category", F.explode_outer(kept).alias("attribute", "v")).select("policy", "annotation_id", "segment", "category", "attribute", F.col("v.value").alias("value"), F.when(~F.col("v.selectedText").isin("null", "Not selected"), F.col("v.selectedText")).alias("text"))


def accumulated(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, item, data_categories, actions): rows of a key are read in order and what they mention is gathered until it
    has a category and an action; that is an item, and the gathering begins anew. What is left at the end is dropped."""
    each = rows.select(key, F.struct(F.col(order).alias("o"), X.found_terms(F.col(text), T.TEXT_DATA).alias("d"), X.found_terms(F.col(text), T.TEXT_ACTION).alias("a")).alias("r"))
    listed = each.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    empty = F.array().cast("array<string>")
    item = "array<struct<d:array<string>,a:array<string>>>"

    def step(acc: Column, r: Column) -> Column:
        d, a = F.array_union(acc["d"], r["d"]), F.array_union(acc["a"], r["a"])
        full = (F.size(d) > 0) & (F.size(a) > 0)
        return F.struct(F.when(full, empty).otherwise(d).alias("d"), F.when(full, empty).otherwise(a).alias("a"), F.when(full, F.array_append(acc["items"], F.struct(F.array_sort(d).alias("d"), F.array_sort(a).alias("a")))).otherwise(acc["items"]).alias("items"))

    folded = F.aggregate("rows", F.struct(empty.alias("d"), empty.alias("a"), F.array().cast(item).alias("items")), step, lambda acc: acc["items"])
    return listed.select(key, F.posexplode(folded).alias("item", "x")).select(key, "item", F.col("x.d").alias("data_categories"), F.col("x.a").alias("actions"))


def paragraphs(rows: DataFrame, key: str, text: str, least: int = 50) -> DataFrame:
    """(key, paragraph, start, text): parts between blank lines, longer than least characters when trimmed; start in characters."""
    parts = F.split(F.col(text), "\n\n", -1)
    x = rows.select(key, F.posexplode(parts).alias("paragraph", "part"), parts.alias("parts"))
    start = F.aggregate(F.slice("parts", F.lit(1), F.col("paragraph")), F.lit(0), lambda s, p: s + F.length(p) + 2)
    return x.select(key, "paragraph", start.alias("start"), F.col("part").alias("text")).where(F.length(F.trim("text")) > least)


def policies_html(pages: DataFrame, limit: int = 3500) -> DataFrame:
    return pages.select("page_id", X.strip_html(F.col("html"), limit).alias("text"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(context, question, category) of nested question files; the category is what precedes three pipes in the type."""
    d = spark.read.schema(SQUAD).option("multiLine", True).json(path)
    p = d.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    return p.select("p.context", F.explode("p.qas").alias("q")).select("context", "q.question", F.get(F.split("q.type", r"\|\|\|"), F.lit(0)).alias("category"))


def synthetic_profiles(rows: DataFrame, fields=("sex", "city_country", "birth_city_country", "education", "occupation", "relationship_status")) -> DataFrame:
    """(response, risk_score, sensitive_fields): profile values of three characters or more that the response contains."""
    r = F.coalesce("response", F.lit(""))
    values = F.flatten(F.transform(F.array(*[F.coalesce(F.col("personality")[f], F.lit("")) for f in fields]), lambda v: F.transform(F.split(v, ","), F.trim)))
    kept = F.array_distinct(F.filter(values, lambda v: (F.length(v) >= 3) & F.contains(F.lower(r), F.lower(v))))
    risk = F.least(F.lit(0.95), F.greatest(F.lit(0.5), F.lit(0.5) + 0.1 * F.coalesce("hardness", F.lit(1))))
    return rows.where(r != "").select("response", risk.alias("risk_score"), kept.alias("sensitive_fields")).where(F.size("sensitive_fields") > 0)


def feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).json(path).where(F.col("target_label").isNotNull())


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_feedback(rows: DataFrame, path: str) -> None:
    """Appends the rows that have a label; others are not learned from."""
    append_json(rows.where(F.col("target_label").isNotNull()), path)


def behaviours(spark: SparkSession, path: str) -> DataFrame:
    """Behaviours as append_json writes them; blank lines are passed over."""
    return spark.read.schema(BEHAVIOUR).json(path).where(F.coalesce("domain", "generation_type", F.col("statement_id").cast("string")).isNotNull() | F.col("behavior").isNotNull())


def audit_rows(decisions: DataFrame) -> DataFrame:
    """What the audit log keeps of decisions: never content, and only evidence that has an id."""
    return decisions.select("ts", "event_id", "decision", "risk_score", F.array_compact(F.transform("evidence", lambda e: e["evidence_id"])).alias("evidence_ids"))


def evidence_rows(decisions: DataFrame, statements: DataFrame) -> DataFrame:
    """(decision_id, policy_statement_id): evidence ids doc:statement, cut at the first colon; those without one, broken or unknown ones are left out."""
    e = decisions.select("decision_id", F.explode("evidence_ids").alias("e")).select("decision_id", F.expr("CASE WHEN locate(':', e) > 0 THEN try_cast(substring(e, locate(':', e) + 1) as bigint) END").alias("id")).where("id is not null")
    return e.join(statements.select("id"), "id").select("decision_id", F.col("id").alias("policy_statement_id"))


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier run has written."""
    return rows.join(done.select(key), key, "left_anti")


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A sample of n rows that any engine repeats: those of the least md5(seed|key)."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def best_and_worst(rows: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """(by, key, which) of the greatest and least value of each group; ties by key."""
    w = W.Window.partitionBy(by)
    x = rows.withColumns({"_b": F.row_number().over(w.orderBy(F.col(value).desc(), key)), "_w": F.row_number().over(w.orderBy(value, key))})
    return x.where("_b = 1").select(by, key, F.lit("best").alias("which")).unionByName(x.where("_w = 1").select(by, key, F.lit("worst").alias("which")))


def to_markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table, built on the driver; ValueError for more than most rows."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    lines = [rows.columns, ["---"] * len(rows.columns), *[["" if v is None else str(v) for v in r] for r in got]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def relevance(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """(query, segment, gold) of tab-separated relevance judgements: Any_Relevant, else the majority of six annotators (ties: Irrelevant)."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path).where(F.col("Split") == split)
    votes = F.filter(F.array(*[F.col(f"Ann{k}") for k in range(1, 7)]), lambda v: F.coalesce(v, F.lit("None")) != "None")
    yes = F.size(F.filter(votes, lambda v: v == "Relevant"))
    majority = F.when(2 * yes > F.size(votes), "Relevant").otherwise("Irrelevant")
    return t.select(F.col("Query").alias("query"), F.col("Segment").alias("segment"), F.coalesce(F.when(F.col("Any_Relevant") != "", F.col("Any_Relevant")), majority).alias("gold"))


def events_or_rules(rows: DataFrame, labels: dict[str, str], least: int = 30) -> DataFrame:
    """(text, category): of annotated sentences the mapped event types; of others, long enough, a category by the actions that their words tell."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    types = F.array_distinct(F.array_compact(F.transform(F.coalesce("event_mentions", F.array().cast("array<struct<event_type:string>>")), lambda e: F.try_element_at(known, e["event_type"]))))
    acts = X.found_terms(F.col("text"), T.TEXT_ACTION)
    rule = F.when(F.array_contains(acts, "Share") | F.array_contains(acts, "Transfer"), CATEGORIES[1]).when(F.array_contains(acts, "Control"), CATEGORIES[2]).when(F.array_contains(acts, "Store"), CATEGORIES[4]).otherwise(CATEGORIES[0])
    found = F.when(F.size(types) > 0, types).otherwise(F.when(F.length("text") >= least, F.array(rule)).otherwise(F.array().cast("array<string>")))
    return rows.select("text", F.explode(found).alias("category"))


def masked_texts(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, text, sensitive_fields, category, risk_score) of English texts of 80 to 1500 characters with marked values; samples by hash order."""
    m = F.coalesce("privacy_mask", F.array().cast("array<struct<label:string,value:string>>"))
    values = F.array_distinct(F.transform(m, lambda x: x["value"]))
    kinds = F.slice(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), 1, 6)
    x = rows.where((F.lower("language") == "english") & F.length("source_text").between(80, 1500) & (F.size(m) > 0))
    x = x.select("id", F.col("source_text").alias("text"), values.alias("sensitive_fields"), F.array_join(kinds, "|").alias("category"), F.lit(0.85).alias("risk_score"))
    return first_by_hash(x, "id", limit) if limit else x


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def grouped_annotations(rows: DataFrame, actions: dict[str, str]) -> DataFrame:
    """(policy, segment, data_categories, actions) of annotation rows: actions by exact category, data by words; groups with both."""
    known = F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])
    g = rows.groupBy("policy", "segment").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(X.found_terms(F.col("value"), T.TEXT_DATA))))).alias("data_categories"), F.array_sort(F.collect_set(F.try_element_at(known, F.col("category")))).alias("actions"))
    return g.where((F.size("data_categories") > 0) & (F.size("actions") > 0))


def lookup(rows: DataFrame, key: str, value):
    """The row of a key; ValueError where there is none. The filter reaches the scan."""
    got = rows.where(F.col(key) == F.lit(value)).limit(1).collect()
    if not got:
        raise ValueError(f"{key} {value!r} not found")
    return got[0]


def json_strings(x: Column) -> Column:
    """The values of a JSON object as text, in order, joined by blanks."""
    return F.array_join(F.map_values(F.from_json(x, "map<string,string>")), " ")


def policy_texts(spark: SparkSession, folder: str, splits=("train", "test", "dev", "valid")) -> DataFrame:
    """(split, text) of files <split>.txt, .json, .jsonl and .tsv below a folder; missing ones are passed by.

    A line of txt or tsv is a text; of a JSON item its text, else its sentence, else the item itself.
    """
    out = spark.createDataFrame([], "split string, text string")
    for split in splits:
        for kind in ("txt", "tsv", "json", "jsonl"):
            raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{split}.{kind}").option("wholetext", str(kind == "json").lower()).text(folder)
            if kind == "json":
                raw = raw.select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).alias("value"))
            if kind.startswith("json"):
                item = F.from_json("value", "text string, sentence string")
                raw = raw.select(F.coalesce(item["text"], item["sentence"], F.col("value")).alias("value"))
            out = out.unionByName(raw.where(F.length(F.trim("value")) > 0).select(F.lit(split).alias("split"), F.col("value").alias("text")))
    return out


def joined_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(text) of every line of csv and tsv files, its fields joined by blanks, and of every item of JSON lines, its values joined."""
    read = lambda glob: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    flat = read("*.{csv,tsv}").select(F.trim(F.regexp_replace("value", r"[,\t]+", " ")).alias("text"))
    items = read("*.{json,jsonl}").select(json_strings(F.col("value")).alias("text"))
    return flat.unionByName(items).where(F.length("text") > 0)


def paragraphs_or_lines(spark: SparkSession, folder: str, least: int = 50, max_files: int = 5000) -> DataFrame:
    """(file, text): lines of csv files longer than least if any file has one, else paragraphs of md files; files by name up to max_files, the reader's own limit."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).where(F.length("text") > least)
    if lines.limit(1).count():
        found = lines
    else:
        whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
        found = whole.select("file", F.explode(F.split("value", r"\n\s*\n")).alias("text")).select("file", F.trim("text").alias("text")).where(F.length("text") > least)
    first = found.select("file").distinct().orderBy("file").limit(max_files)
    return found.join(first, "file")
