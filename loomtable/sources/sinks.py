"""Writing triples: N-Triples text, Parquet by predicate, and forms that compare graphs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import COLUMNS, SCHEMA
from ..plans.context import XSD


def _escaped(x: Column) -> Column:
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(char), F.lit(code))
    return x


def _lines(triples: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """A line for each triple; name: how predicates, datatypes and other IRIs are written."""
    quoted = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))
    typed = (F.col("o_datatype").isNotNull()) & (F.col("o_datatype") != XSD + "string")
    literal = F.when(F.col("o_lang").isNotNull(), F.concat(quoted, F.lit("@"), F.col("o_lang"))).when(typed, F.concat(quoted, F.lit("^^"), name(F.col("o_datatype")))).otherwise(quoted)
    node = lambda value, kind: F.when(kind == "iri", name(value)).otherwise(value)
    o = F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o"), F.col("o_kind")))
    return triples.select(F.concat(node(F.col("s"), F.col("s_kind")), F.lit(" "), name(F.col("p")), F.lit(" "), o, F.lit(" .")).alias("value"))


def _in_angles(x: Column) -> Column:
    return F.concat(F.lit("<"), x, F.lit(">"))


def ntriples(triples: DataFrame) -> DataFrame:
    """One line of N-Triples for each triple, in the column `value`."""
    return _lines(triples, _in_angles)


def write_ntriples(triples: DataFrame, path: str, mode: str = "error") -> None:
    ntriples(triples).write.mode(mode).text(path)


#: An N-Triples line: subject, predicate, then a node, or a literal with its language or datatype.
#: The text runs to the line's last quotation mark; what it may hold is checked apart, as expressions recurse in long text.
_LINE = r'^\s*(<[^>]*>|_:\S+)\s*<([^>]*)>\s*(?:(<[^>]*>|_:[^\s.]+(?:\.+[^\s.]+)*)|"(.*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>"]*)>)?)\s*\.\s*(?:#[^"]*)?$'
_ESCAPE = r"(?s)^(?:([tbnrf\"'\\])|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))(.*)$"
#: What stands behind a backslash.
_SIMPLE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _character(code: Column) -> Column:
    """The character of a hexadecimal code point."""
    return F.decode(F.unhex(F.lpad(code, 8, "0")), "utf-32")


def unescaped(x: Column) -> Column:
    """Escapes undone in one pass from left to right; one that N-Triples doesn't know stays as it is.

    What follows each backslash is looked at by itself; the second of two backslashes begins nothing.
    """
    parts = F.split(x, r"\\", -1)

    def piece(part: Column) -> Column:
        rest = F.regexp_extract(part, _ESCAPE, 4)
        simple, short, long = (F.regexp_extract(part, _ESCAPE, k) for k in (1, 2, 3))
        plain = F.lit(None).cast("string")
        for code, char in _SIMPLE.items():
            plain = F.when(simple == code, F.lit(char)).otherwise(plain)
        found = F.when(simple != "", plain).when(short != "", _character(short)).when(long != "", _character(long))
        return F.coalesce(F.concat(found, rest), F.concat(F.lit("\\"), part))

    # (text so far, whether a backslash is open): an empty part behind an open backslash is the second of two.
    start = F.struct(F.lit("").alias("done"), F.lit(False).alias("open"))

    def step(state: Column, part: Column) -> Column:
        text = F.when(~state["open"], F.concat(state["done"], part)).when(part == "", F.concat(state["done"], F.lit("\\"))).otherwise(F.concat(state["done"], piece(part)))
        return F.struct(text.alias("done"), F.when(state["open"] & (part == ""), F.lit(False)).otherwise(F.lit(True)).alias("open"))

    return F.when(x.contains("\\"), F.aggregate(parts, start, step, lambda state: state["done"])).otherwise(x)


def _is_triple(line: Column) -> Column:
    """Whether a line is a triple: quotation marks within its text are escaped, and its last backslash escapes something."""
    text = F.regexp_extract(line, _LINE, 4)
    odd = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    return line.rlike(_LINE) & ~odd.contains('"') & ~odd.endswith("\\")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of an N-Triples file. Lines that are none are in unread_ntriples()."""
    line = F.col("value")
    part = lambda k: F.col("_m")[k - 1]
    bare = lambda x: unescaped(F.when(x.startswith("<"), F.substring(x, 2, F.length(x) - 2)).otherwise(x))
    kind = lambda x: F.when(x.startswith("<"), F.lit("iri")).otherwise(F.lit("bnode"))
    is_node = part(3) != ""
    datatype = F.when(is_node, F.lit(None)).when(part(6) != "", unescaped(part(6))).when(part(5) != "", F.lit(None)).otherwise(F.lit(XSD + "string"))
    rows = spark.read.text(path).filter(_is_triple(line)).select(F.array(*[F.regexp_extract(line, _LINE, k) for k in range(1, 7)]).alias("_m"))
    return rows.select(bare(part(1)).alias("s"), kind(part(1)).alias("s_kind"), unescaped(part(2)).alias("p"), F.when(is_node, bare(part(3))).otherwise(unescaped(part(4))).alias("o"), F.when(is_node, kind(part(3))).otherwise(F.lit("literal")).alias("o_kind"), datatype.alias("o_datatype"), F.nullif(part(5), F.lit("")).alias("o_lang"))


def unread_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Lines (file, value) that aren't triples, nor blank, nor comments."""
    return spark.read.text(path).filter(~_is_triple(F.col("value")) & ~F.col("value").rlike(r"^\s*(#.*)?$")).select(F.input_file_name().alias("file"), "value")


def write_parquet(triples: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet with a folder for each predicate, so that a query on predicates reads those alone."""
    triples.write.mode(mode).partitionBy("p").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS)


#: Prefixes that a Turtle file declares.
TURTLE_PREFIXES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "csvw": "http://www.w3.org/ns/csvw#", "xsd": XSD}


def _prefixed(x: Column) -> Column:
    out = _in_angles(x)
    for name, url in TURTLE_PREFIXES.items():
        out = F.when(x.rlike(f"^{re.escape(url)}[A-Za-z][A-Za-z0-9]*$"), F.concat(F.lit(f"{name}:"), F.substring(x, len(url) + 1, 1 << 30))).otherwise(out)
    return out


def turtle(triples: DataFrame) -> DataFrame:
    """Lines of Turtle: IRIs under the declared prefixes are shortened, text never is; the prefix lines come apart, from turtle_head()."""
    return _lines(triples, _prefixed)


def turtle_head() -> str:
    return "".join(f"@prefix {n}: <{u}> .\n" for n, u in TURTLE_PREFIXES.items())


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples that one of two graphs lacks; blank nodes compare by their names."""
    left = a.select(*COLUMNS).distinct()
    right = b.select(*COLUMNS).distinct()
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))
