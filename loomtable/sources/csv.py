"""CSV files by a dialect, as frames of raw strings with row numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.model import Dialect


@dataclass
class Scan:
    """rows: the fields as strings in order, `_row` (from 1) and `_source_row`; header: the first header row, if any."""

    rows: DataFrame
    header: list[str] | None
    #: (_source_row, fields) of the records with fewer fields than the widest
    ragged: DataFrame


def _options(d: Dialect) -> dict[str, str]:
    out = {"sep": d.delimiter, "quote": d.quote_char or "", "escape": ('"' if d.quote_char is None else d.quote_char) if d.double_quote else "\\", "encoding": d.encoding, "header": "false", "emptyValue": "", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    if d.comment_prefix and len(d.comment_prefix) == 1:
        out["comment"] = d.comment_prefix
    if len(d.line_terminators) == 1 and len(d.line_terminators[0]) <= 2:
        out["lineSep"] = d.line_terminators[0]
    return out


def _trimmed(x: Column, trim: str) -> Column:
    return {"true": F.trim, "start": F.ltrim, "end": F.rtrim}.get(trim, lambda c: c)(x)


def _width(lines: DataFrame, delimiter: str) -> int:
    """At least as many fields as the widest record has: delimiters are counted with the quoted ones."""
    count = (F.length("value") - F.length(F.replace("value", F.lit(delimiter), F.lit("")))) / len(delimiter) + 1
    return int(lines.agg(F.max(count)).first()[0] or 1)


def read_csv(spark: SparkSession, path: str, dialect: Dialect | None = None, *, splittable: bool = False) -> Scan:
    """Reads a file whose records may be ragged and may hold line ends within quotes.

    Quoted line ends forbid splitting a file, so one task reads it; with splittable=True a file without
    them is read by many tasks, and rows are numbered after the rows of the partitions before.
    """
    d = dialect or Dialect()
    lines = spark.read.option("encoding", d.encoding).option("wholetext", "false").text(path)
    width = _width(lines, d.delimiter)
    names = [f"_c{k}" for k in range(width)]
    schema = ", ".join(f"`{n}` string" for n in names)
    options = _options(d)
    if d.comment_prefix and len(d.comment_prefix) > 1:  # the reader knows one character only
        kept = lines.filter(~F.col("value").startswith(d.comment_prefix)).withColumn("_at", F.monotonically_increasing_id())
        parsed = kept.filter("value <> ''").select("_at", F.from_csv("value", F.lit(schema), {k: v for k, v in options.items() if k not in ("encoding", "header")}).alias("r")).select("_at", "r.*")
    else:
        parsed = spark.read.schema(schema).options(**options).option("multiLine", str(not splittable).lower()).csv(path).withColumn("_at", F.monotonically_increasing_id())
    parsed = _numbered(parsed)
    top = parsed.filter(F.col("_at") < d.skip_rows + d.header_rows).orderBy("_at").collect()  # skipped and header rows only
    head = [r for r in top if r["_at"] >= d.skip_rows]
    used = parsed.agg(F.max(F.greatest(*[F.when(F.col(n).isNotNull(), F.lit(k + 1)).otherwise(F.lit(0)) for k, n in enumerate(names)], F.lit(1)))).first()[0] or 1 if width > 1 else 1
    names = names[d.skip_columns : used]
    header = None
    if head and d.header_rows:
        header = [(head[0][n] or "").lstrip("﻿") for n in names]
        while header and header[-1] == "" and head[0][names[len(header) - 1]] is None:
            header.pop()  # data rows may be wider than the header
    rows = parsed.filter(F.col("_at") >= d.skip_rows + d.header_rows)
    if d.skip_blank_rows:
        rows = rows.filter(~F.forall(F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names]), lambda x: F.trim(x) == ""))
    source = F.col("_at") + 1
    ragged = _short(spark, path, d, options, schema, width, used, splittable)
    fields = [F.coalesce(_trimmed(F.col(n), d.trim), F.lit("")).alias(header[k] if header and k < len(header) and header[k] and header.count(header[k]) == 1 else f"_col.{k + 1}") for k, n in enumerate(names)]
    if d.skip_blank_rows:
        # Skipped records leave a gap in the source's numbers only; they are few tasks' counts, as above.
        rows = _numbered(rows.withColumn("_was", F.col("_at")).drop("_at").withColumn("_at", F.monotonically_increasing_id()))
        row, source = F.col("_at") + 1, F.col("_was") + 1
    else:
        row = F.col("_at") - (d.skip_rows + d.header_rows) + 1
    return Scan(rows.select(*fields, row.alias("_row"), source.alias("_source_row")), header, ragged)


def _short(spark: SparkSession, path: str, d: Dialect, options: dict[str, str], schema: str, width: int, used: int, splittable: bool) -> DataFrame:
    """(_source_row, fields) of the records with fewer fields than the widest; a scan of its own, once it is asked for.

    The reader hands over the text of a record that hasn't all fields; delimiters outside of quotes are counted there.
    With a comment prefix of several characters there are none, as such files are read line by line.
    """
    if width == 1 or (d.comment_prefix and len(d.comment_prefix) > 1):
        return spark.createDataFrame([], "_source_row long, fields int")
    read = spark.read.schema(f"{schema}, _raw string").options(**options).option("columnNameOfCorruptRecord", "_raw").option("multiLine", str(not splittable).lower()).csv(path)
    rows = _numbered(read.select("_c0", "_raw", F.monotonically_increasing_id().alias("_at"))).filter(F.col("_at") >= d.skip_rows + d.header_rows)
    rows = rows.filter(F.col("_c0").isNotNull() | F.col("_raw").isNotNull())  # others are whole; Spark refuses to read _raw alone
    quote = re.escape(d.quote_char) if d.quote_char else None
    bare = F.regexp_replace("_raw", f"{quote}[^{quote}]*{quote}", "_") if quote else F.col("_raw")
    fields = F.when(F.col("_raw").isNull(), F.lit(width)).otherwise(F.size(F.split(bare, re.escape(d.delimiter), -1)))
    rows = rows.select((F.col("_at") + 1).alias("_source_row"), fields.alias("fields"), F.trim(F.replace("_raw", F.lit(d.delimiter), F.lit(""))).alias("_text")).filter(F.col("fields") < used)
    return (rows.filter("coalesce(_text, '') <> ''") if d.skip_blank_rows else rows).drop("_text")


def _numbered(df: DataFrame) -> DataFrame:
    """`_at` from monotonically increasing numbers to 0, 1, 2, ...: partitions follow those before them."""
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    keyed = df.withColumn("_part", part).withColumn("_within", within)
    return keyed.join(F.broadcast(before), "_part").withColumn("_at", (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_within", "_before")
