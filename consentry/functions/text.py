"""Text functions as Column expressions: tokens, HTML, recognisers with offsets, rewriting levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then refers to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two token arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def strip_html(html: Column, limit: int | None = None) -> Column:
    """Without script and style blocks and tags, white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"\s+", " "))
    return F.left(x, F.lit(limit)) if limit else x


def found_terms(text: Column, terms: dict[str, str]) -> Column:
    """Sorted different values of the keys that the lower-cased text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    by: dict[str, list[str]] = {}
    for k, v in terms.items():
        by.setdefault(v, []).append(k)
    hits = [F.when(_any(low, keys), F.lit(v)) for v, keys in sorted(by.items())]
    return F.array_compact(F.array(*hits))


def _any(low: Column, keys: list[str]) -> Column:
    out = F.contains(low, F.lit(keys[0]))
    for k in keys[1:]:
        out |= F.contains(low, F.lit(k))
    return out


def sensitive_phrases(text: Column) -> Column:
    """Per category its longest phrase in the text (first of equals), by phrase length, then category order."""

    def hits(low: Column) -> Column:
        out = []
        for k, (category, phrases) in enumerate(T.PHRASES.items()):
            ranked = sorted(phrases, key=lambda p: -len(p))
            hit = F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in ranked])  # stops at the first
            out.append(F.struct(F.lit(k).alias("k"), F.lit(category).alias("category"), hit.alias("matched_phrase")))
        found = F.filter(F.array(*out), lambda x: x["matched_phrase"].isNotNull())
        return F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x["matched_phrase"])).alias("o"), x["k"].alias("k"), x["category"].alias("category"), x["matched_phrase"].alias("matched_phrase"))))

    return F.transform(let(F.lower(F.coalesce(text, F.lit(""))), hits), lambda x: F.struct(x["category"].alias("category"), x["matched_phrase"].alias("matched_phrase"), F.lit(0.7).alias("confidence"), F.lit("keyword").alias("method")))


#: What a text has if a recogniser finds anything in it; cheap to look for, so most texts are passed by.
HINTS = {
    "EMAIL": lambda t: F.contains(t, F.lit("@")),
    "PHONE": lambda t: F.regexp_like(t, F.lit(r"\d[\d\s()-]{7}")),
    "CREDIT_CARD": lambda t: F.regexp_like(t, F.lit(r"\d(?:[ -]*\d){12}")),
    "API_KEY": lambda t: _any(t, ["AKIA", "SK", "eyJ", "ghp_", "ya29."]),
}


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, end, type, value>> of the pattern's matches; offsets in code points, end exclusive.

    Offsets follow from the lengths of the matches and of the parts between.
    """
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,type:string,value:string,granularity:int>>")

    def add(acc: Column, v: Column) -> Column:
        start = acc["at"] + F.length(F.get(acc["parts"], F.size(acc["out"])))
        one = F.struct(start.cast("int").alias("start"), (start + F.length(v)).cast("int").alias("end"), F.lit(kind).alias("type"), v.alias("value"), F.lit(0).alias("granularity"))
        return F.struct((start + F.length(v)).cast("int").alias("at"), acc["parts"].alias("parts"), F.array_append(acc["out"], one).alias("out"))

    # the parts between travel with the fold, so the text is scanned once for them and once for the matches
    begin = F.struct(F.lit(0).alias("at"), F.split(t, pattern, -1).alias("parts"), none.alias("out"))
    hint = HINTS.get(kind, lambda t: F.regexp_like(t, F.lit(pattern)))
    return F.when(hint(t), F.aggregate(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), begin, add, lambda acc: acc["out"])).otherwise(none)


def entities(text: Column) -> Column:
    """All recognisers' matches, in recogniser order; matches of different recognisers may overlap."""
    return F.concat(*[matches(text, p, k) for k, p in T.ENTITIES.items()])


def cleanup(text: Column) -> Column:
    x = text
    for pattern, to in ((r",\s*,", ","), (r"\s{2,}", " "), (r",\s*$", ""), (r"^\s*,", ""), (r"(in|at|to|from|near|around)\s*,\s*", "$1 "), (r"^\s+|\s+$", "")):
        x = F.regexp_replace(x, pattern, to)
    return x


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _mask(e: Column, lvl: int) -> Column:
    v, kind, g = e["value"], e["type"], e["granularity"]
    d = _digits(v)
    last4 = F.substring(d, -4, 4)
    parts = F.split(v, "@")
    two = F.size(parts) == 2
    if lvl == 3:
        return F.concat(F.lit("["), kind, F.lit("]"))
    if lvl == 2:
        return (
            F.when(kind == "EMAIL", F.when(two, F.concat(F.lit("***@"), F.get(parts, F.lit(1)))).otherwise("[EMAIL]"))
            .when(kind == "PHONE", F.when(F.length(d) >= 4, F.concat(F.lit("***"), last4)).otherwise("[PHONE]"))
            .when(kind == "CREDIT_CARD", F.when(F.length(d) >= 4, F.concat(F.lit("**** **** **** "), last4)).otherwise("[CARD]"))
            .when(kind == "API_KEY", F.concat(F.left(v, F.lit(4)), F.lit("****")))
            .when(kind.isin("LOCATION", "ORG", "DEMOGRAPHIC"), F.when(g >= 4, v).otherwise(""))
            .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
        )
    words = F.split(F.trim(v), r"\s+")
    year = F.regexp_extract(v, r"\b(19|20)\d{2}\b", 0)
    return (
        F.when(kind == "EMAIL", F.when(two, F.concat(F.left(v, F.lit(1)), F.lit("***@"), F.get(parts, F.lit(1)))).otherwise("[EMAIL]"))
        .when(kind == "PHONE", F.when(F.length(d) >= 7, F.concat(F.left(d, F.lit(3)), F.lit("****"), F.substring(d, -2, 2))).otherwise("[PHONE]"))
        .when(kind == "CREDIT_CARD", F.when(F.length(d) >= 8, F.concat(F.left(d, F.lit(4)), F.lit(" **** **** "), last4)).otherwise("[CARD]"))
        .when(kind == "API_KEY", F.concat(F.left(v, F.lit(6)), F.lit("..."), F.substring(v, -4, 4)))
        .when(kind == "PERSON", F.when(F.size(words) >= 2, F.concat(F.left(v, F.lit(1)), F.lit(". "), F.element_at(words, -1))).otherwise(F.concat(F.left(v, F.lit(1)), F.lit("."))))
        .when(kind.isin("LOCATION", "ORG"), F.when(g <= 1, "").otherwise(v))
        .when(kind == "DATE", F.when(year != "", year).otherwise("[DATE]"))
        .when(kind == "DEMOGRAPHIC", v)
        .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    )


def rewrite(text: Column, found: Column, lvl: int) -> Column:
    """text with each entity masked at level 1, 2 or 3 (higher levels without a rewriter: 3), from right to left.

    Offsets are those of the input: where entities overlap, a later splice eats what follows.
    """
    lvl = min(lvl, 3)
    order = F.transform(F.sort_array(F.transform(found, lambda e, i: F.struct(e["start"].alias("s"), (-i).alias("i"), e.alias("e"))), asc=False), lambda x: x["e"])
    out = F.aggregate(order, F.coalesce(text, F.lit("")), lambda acc, e: F.concat(F.left(acc, e["start"]), _mask(e, lvl), F.substring(acc, e["end"] + 1, F.length(acc))))
    if lvl == 3:
        out = _merged(out)
    return cleanup(out)


def rewrites(text: Column, found: Column, then: Callable[[Callable[[int], Column]], Column]) -> Column:
    """then(at), with at(lvl) as rewrite has it.

    Entities that do not overlap share the parts between them, which are cut out once for all levels; of others each level is spliced.
    """
    t = F.coalesce(text, F.lit(""))
    order = F.transform(F.sort_array(F.transform(found, lambda e, i: F.struct(e["start"].alias("s"), (-i).alias("i"), e.alias("e")))), lambda x: x["e"])

    def cut(es: Column) -> Column:
        follows = F.zip_with(F.slice(es, F.lit(2), F.size(es) - 1), F.slice(es, F.lit(1), F.size(es) - 1), lambda b, a: b["start"] >= a["end"])
        ends, starts = F.concat(F.array(F.lit(0)), F.transform(es, lambda e: e["end"])), F.concat(F.transform(es, lambda e: e["start"]), F.array(F.length(t)))
        parts = F.zip_with(ends, starts, lambda a, b: F.substring(t, a + 1, b - a))
        return F.when(F.forall(follows, lambda x: x), parts)

    def joined(parts: Column, masks: Column) -> Column:
        return F.when(~F.exists(masks, lambda m: m.isNull()), F.array_join(F.zip_with(parts, F.concat(masks, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), ""))

    def at(es: Column, parts: Column, lvl: int) -> Column:
        lvl = min(lvl, 3)
        out = let(F.transform(es, lambda e: _mask(e, lvl)), lambda masks: joined(parts, masks))
        return F.when(parts.isNull(), rewrite(text, found, lvl)).otherwise(cleanup(_merged(out) if lvl == 3 else out))

    def some(es: Column) -> Column:
        return let(cut(es), lambda parts: then(lambda lvl: at(es, parts, lvl)))

    return F.when(F.size(found) == 0, then(lambda lvl: rewrite(text, found, lvl))).otherwise(let(order, some))


def _merged(text: Column) -> Column:
    """Neighbouring tags of one kind as one."""
    return F.regexp_replace(text, r"\[([A-Z]+)\](?:\s*,?\s*\[(\1)\])+", "[$1]")


def lexical_verified(guess: Column, original: Column) -> Column:
    """Whether the original contains the trimmed guess, or they share a word of over two characters."""
    g, o = F.lower(F.trim(guess)), F.lower(original)
    long = lambda x: F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 2)
    return F.contains(o, g) | (F.size(F.array_intersect(long(g), long(o))) > 0)


def retained(text: Column, fields: Column) -> Column:
    """Share of the sensitive fields that the text still contains; 0 without fields."""
    f = F.coalesce(fields, F.array().cast("array<string>"))
    return F.when(F.size(f) == 0, 0.0).otherwise(F.size(F.filter(f, lambda x: F.contains(F.lower(text), F.lower(x)))) / F.size(f))


def shared_of_first(a: Column, b: Column) -> Column:
    """Share of the different tokens of a that b also has; 0 without any."""
    own = F.array_distinct(tokens(a))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, tokens(b))) / F.size(own))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object of string and string array columns, keys sorted, with ", " and ": " between; null is null."""
    parts = []
    for k in sorted(fields):
        x = fields[k]
        parts += [F.lit(f'"{k}": '), F.coalesce(x, F.lit("null")), F.lit(", ")]
    return F.concat(F.lit("{"), *parts[:-1], F.lit("}"))


def json_text(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def json_list(x: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(x), json_text), ", "), F.lit("]"))


def first_per_category(text: Column, recognisers: dict[str, str], category: dict[str, str], confidence: float = 0.8) -> Column:
    """The first entity of each category, in order of place: what a recogniser without a model can tell.

    recognisers: pattern of each entity label; category: that a label tells (fixed by the caller). Any
    client that returns the same array can take the place of the patterns.
    """
    found = F.array_sort(F.concat(*[matches(text, p, k) for k, p in recognisers.items()]))

    def first(e: Column) -> Column:
        names = F.array(*[F.lit(c) for c in dict.fromkeys(category[k] for k in recognisers)])
        of = lambda x: F.coalesce(*[F.when(x["type"] == k, F.lit(category[k])) for k in recognisers])
        each = F.transform(names, lambda n: F.struct(n.alias("category"), F.get(F.filter(e, lambda x: of(x) == n), F.lit(0)).alias("e")))
        kept = F.filter(each, lambda x: x["e"].isNotNull())
        return F.transform(kept, lambda x: F.struct(x["category"].alias("category"), x["e"]["value"].alias("value"), x["e"]["start"].alias("start"), F.lit(confidence).alias("confidence"), F.lit("ner").alias("method")))

    return let(found, first)
