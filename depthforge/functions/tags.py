"""Optional tags of alignments (``TG:T:value``) and header lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Byte width of the tag types; fixed values of the BAM format (0: variable).
TYPE_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4, "d": 8, "Z": 0, "H": 0, "B": 0}


def parse_tags(fields: Column) -> Column:
    """map<tag, struct<type, value>> of an array of ``TG:T:value``; the first of equal tags counts."""
    entry = lambda x: F.struct(F.substring(x, 1, 2), F.struct(F.substring(x, 4, 1).alias("type"), F.substring(x, F.lit(6), F.length(x)).alias("value")))
    good = F.filter(fields, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[AcCsSiIfdZHB]:"))
    firsts = F.filter(good, lambda x, i: F.array_position(F.transform(good, lambda y: F.substring(y, 1, 2)), F.substring(x, 1, 2)) == i + 1)
    return F.map_from_entries(F.transform(firsts, entry))


def tag_int(tags: Column, tag: str) -> Column:
    """Integer value, 0 if the tag is missing or has another type."""
    return F.coalesce(F.when(tags[tag]["type"].isin(*"cCsSiI"), tags[tag]["value"].try_cast("bigint")), F.lit(0))


def tag_float(tags: Column, tag: str) -> Column:
    return F.coalesce(F.when(tags[tag]["type"].isin("f", "d"), tags[tag]["value"].try_cast("double")), F.lit(0.0))


def tag_text(tags: Column, tag: str) -> Column:
    return F.when(tags[tag]["type"].isin("Z", "H"), tags[tag]["value"])


def tag_char(tags: Column, tag: str) -> Column:
    return F.when(tags[tag]["type"] == "A", F.substring(tags[tag]["value"], 1, 1))


def tag_array(tags: Column, tag: str) -> Column:
    """Elements of a typed array tag (its first field is the element type)."""
    parts = F.split(tags[tag]["value"], ",")
    return F.when(tags[tag]["type"] == "B", F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double")))


def put_tag(tags: Column, tag: str, kind: str, value: Column) -> Column:
    return F.map_concat(drop_tag(tags, tag), F.create_map(F.lit(tag), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))


def drop_tag(tags: Column, tag: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != tag)


def keep_tag(tags: Column, tag: str) -> Column:
    return F.map_filter(tags, lambda k, _: k == tag)


def type_size(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, n) for k, n in TYPE_SIZES.items()), F.lit(0))


def parse_header(line: Column) -> Column:
    """struct<type, tags map, text> of a header line; values may hold colons, @CO keeps its text whole."""
    kind = F.substring(line, 2, 2)
    fields = F.filter(F.slice(F.split(line, "\t"), 2, 1_000_000), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:"))
    keys = F.transform(fields, lambda x: F.substring(x, 1, 2))
    firsts = F.filter(fields, lambda x, i: F.array_position(keys, F.substring(x, 1, 2)) == i + 1)
    tags = F.map_from_entries(F.transform(firsts, lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, F.lit(4), F.length(x)))))
    return F.when(line.rlike("^@[A-Z]{2}(\t|$)"), F.struct(kind.alias("type"), F.when(kind != "CO", tags).alias("tags"), F.when(kind == "CO", F.substring(line, F.lit(5), F.length(line))).alias("text")))


def format_header(kind: Column, tags: Column, text: Column) -> Column:
    fields = F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.when(kind == "CO", F.concat(F.lit("@CO\t"), text)).otherwise(F.concat(F.lit("@"), kind, F.lit("\t"), F.array_join(fields, "\t")))
