"""Schemas that drift between the files of a feed: one table of canonical fields, and the ordered list of changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.colmap import look, map_headers
from tallyloom.sources.schema import FIELDS

#: The kinds of a value, each with a bit: what is seen of a field in any set of files is the union of the bits.
KINDS = {"boolean": 1, "bigint": 2, "double": 4, "date": 8, "timestamp": 16, "string": 32, "nested": 64}
#: The type lattice: void below all; bigint below double, date below timestamp; string above all (nested values are kept as their text).
ABOVE = {"boolean": ("boolean",), "double": ("bigint", "double"), "bigint": ("bigint",), "timestamp": ("date", "timestamp"), "date": ("date",)}


def least_type(bits: Column) -> Column:
    """The least type of the lattice that is above all kinds seen."""
    c = F.when(bits == 0, "void")
    for t in ("boolean", "bigint", "double", "date", "timestamp"):
        under = sum(KINDS[k] for k in ABOVE[t])
        c = c.when(bits.bitwiseOR(F.lit(under)) == F.lit(under), t)
    return c.otherwise("string")


def headers_of_files(extracts: DataFrame) -> DataFrame:
    """One row per file and header of its payloads, with the counts of filled values by JSON type.

    Payloads are read as VARIANT inside the JVM; the counts are combined before the shuffle, so a file with a third of all lines costs its
    task one row per header and map task. A payload that is no JSON object has no headers.
    """
    spark = extracts.sparkSession
    lines = extracts.select("file_id", "feed", "received_at", F.try_parse_json("payload").alias("_v")).filter("schema_of_variant(_v) like 'OBJECT%'")
    keys = spark.sql("select l.file_id, l.feed, l.received_at, x.key, x.value from {l} l, lateral variant_explode(l._v) x", l=lines)
    kind = F.expr("schema_of_variant(value)")
    filled = ~kind.isin("VOID") & ~((kind == "STRING") & (F.trim(F.expr("try_variant_get(value, '$', 'string')")) == ""))
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    number = whole | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    text = F.when(kind == "STRING", F.trim(F.expr("try_variant_get(value, '$', 'string')")))
    seen = (
        F.when(~filled, 0).when(kind == "BOOLEAN", KINDS["boolean"]).when(whole, KINDS["bigint"]).when(number, KINDS["double"])
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), KINDS["date"]).when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), KINDS["timestamp"])
        .when(kind == "STRING", KINDS["string"]).otherwise(KINDS["nested"])
    )
    rows = keys.select("file_id", "feed", "received_at", "key", filled.alias("f"), number.alias("n"), (kind == "STRING").alias("s"), seen.alias("k"))
    return rows.groupBy("file_id", "feed", "received_at", "key").agg(
        F.count_if(F.col("n")).alias("numbers"),
        F.bit_or("k").alias("kinds"),
        F.count_if(F.col("f") & F.col("s")).alias("strings"),
        F.count_if(F.col("f")).alias("filled"),
    )


def _fields(headers: pd.Series) -> pd.Series:
    return headers.map(lambda hs: [{"key": h, "field": f, "look": look(h)} for h, f in map_headers(sorted(hs)).items()])


def fields_of_files(headers: DataFrame) -> DataFrame:
    """One row per file and canonical field: its header, the header without case, spaces and punctuation, and the counts."""
    files = headers.groupBy("file_id").agg(F.collect_set("key").alias("keys"))
    to_fields = F.pandas_udf(_fields, "array<struct<key: string, field: string, look: string>>")
    mapped = files.select("file_id", F.inline(to_fields("keys")))
    return headers.join(mapped, ["file_id", "key"])


def kind_of() -> Column:
    """What most filled values are: number, string, or null where neither prevails."""
    return F.when(F.col("numbers") > F.col("strings"), "number").when(F.col("strings") > F.col("numbers"), "string")


def schema_changes(extracts: DataFrame) -> DataFrame:
    """(feed, file_id, received_at, field, change, before, after): what a file changed against the file of its feed received before.

    Changes are added, removed, renamed and retyped. The first file of a feed has none. Files received at the same time follow by
    ``file_id``. Null payloads and empty files count as files without columns only if they have a line; an empty table gives none.
    """
    per_field = fields_of_files(headers_of_files(extracts)).select(
        "file_id", "field", F.struct(F.col("key").alias("header"), "look", kind_of().alias("kind")).alias("now")
    )
    files = extracts.groupBy("feed", "file_id").agg(F.min("received_at").alias("received_at"))
    by_feed = Window.partitionBy("feed").orderBy("received_at", "file_id")
    files = files.withColumn("next_id", F.lead("file_id").over(by_feed)).withColumn("first", F.lag("file_id").over(by_feed).isNull())
    known = per_field.join(files.select("file_id", "next_id"), "file_id")
    # each field of a file counts once as the state of its own file, once as what the next file found
    sides = known.select("file_id", "field", "now", F.lit(None).cast(per_field.schema["now"].dataType).alias("before")).unionByName(
        known.filter("next_id is not null").select(F.col("next_id").alias("file_id"), "field", F.lit(None).cast(per_field.schema["now"].dataType).alias("now"), F.col("now").alias("before"))
    )
    both = sides.groupBy("file_id", "field").agg(F.first("now", True).alias("now"), F.first("before", True).alias("before"))
    both = both.join(files.filter(~F.col("first")).select("feed", "file_id", "received_at"), "file_id")
    changes = F.array_compact(
        F.array(
            F.when(F.col("before").isNull(), "added"),
            F.when(F.col("now").isNull(), "removed"),
            F.when(F.col("now.look") != F.col("before.look"), "renamed"),
            F.when(F.col("now.kind") != F.col("before.kind"), "retyped"),
        )
    )
    return both.select("feed", "file_id", "received_at", "field", F.explode(changes).alias("change"), "before", "now")


def promotions(extracts: DataFrame) -> DataFrame:
    """(feed, file_id, received_at, field, before, after): each time a file makes the type of a field of its feed rise in the lattice.

    The types of the files of a feed are folded in the order of their reception. A field's first type is no rise, but void is (a field that had no
    filled value before). A task has the files of one feed and field.
    """
    order = Window.partitionBy("feed", "field").orderBy("received_at", "file_id")
    seen = fields_of_files(headers_of_files(extracts)).select("feed", "file_id", "received_at", "field", "kinds")
    run = seen.withColumn("after", least_type(F.bit_or("kinds").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    run = run.withColumn("before", F.lag("after").over(order))
    return run.filter("before <> after").select("feed", "file_id", "received_at", "field", "before", "after")


def unified(extracts: DataFrame) -> DataFrame:
    """All lines as one table: raw_id, file_id, line_no and every canonical field, in the type that the lattice gives it.

    A field that no file has is a null string. Only the folded types (at most one row per canonical field) reach the driver.
    """
    headers = headers_of_files(extracts)
    fields = fields_of_files(headers)
    types = {r["field"]: r["type"] for r in fields.groupBy("field").agg(least_type(F.bit_or("kinds")).alias("type")).collect()}
    of_file = fields.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "key"))).alias("_header"))
    lines = extracts.select("raw_id", "file_id", "line_no", F.from_json("payload", "map<string,string>").alias("_values"))
    j = lines.join(of_file, "file_id", "left")
    columns = []
    for f in FIELDS:
        text = F.try_element_at("_values", F.try_element_at("_header", F.lit(f)))
        kind = types.get(f, "string")
        columns.append((text if kind in ("string", "void") else text.try_cast(kind)).alias(f))
    return j.select("raw_id", "file_id", "line_no", *columns)
