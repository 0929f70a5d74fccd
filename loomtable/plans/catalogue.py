"""Queries over the shared tables, each a description applied to them, and SQL of the same meaning."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..convert import convert_frames, convert_group
from ..functions.datatypes import REGISTRY
from ..operators.triples import distinct_triples, pivot_back
from ..sources import sinks
from ..sources.discovery import MemoryResolver
from ..sources.rows import number_rows
from ..sources.spread import spread
from ..streaming.stream import stream_triples
from .metadata import parse_metadata

Query = Callable[[SparkSession, str], DataFrame]

BASE = "http://example.org/"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
CSVW = "http://www.w3.org/ns/csvw#"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- helpers


def load(spark: SparkSession, sf_dir: str, table: str, **columns: Column) -> DataFrame:
    """A table, or expressions over it under the given names; Spark reads only what they need."""
    df = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return df.select(*[c.alias(n) for n, c in columns.items()]) if columns else df


def money(name: str) -> Column:
    """Doubles are written through a decimal: engines differ in how they print doubles."""
    return F.col(name).cast("decimal(18,2)").cast("string")


def table(name: str, columns: list[dict], **more) -> dict:
    return {"url": f"{BASE}{name}", "tableSchema": {"columns": columns}} | more


def shared_folder(spark: SparkSession) -> str:
    """A fresh place that all executors see. Only a session on one machine (tests) may leave spark.checkpoint.dir unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(told or os.path.join(tempfile.gettempdir(), "loomtable-checkpoints"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def sql_triples(source: str, s: str, p: str, o: str, *, o_kind: str = "literal", datatype: str | None = XSD + "string", lang: str | None = None, s_kind: str = "iri", where: str | None = None) -> str:
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
    kind = datatype if o_kind == "literal" and lang is None else None
    return f"SELECT {s} AS s, '{s_kind}' AS s_kind, {p} AS p, {o} AS o, '{o_kind}' AS o_kind, {text(kind)} AS o_datatype, {text(lang)} AS o_lang FROM {source} WHERE {where or f'({o}) IS NOT NULL'}"


def union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


# --- subjects, predicates, objects

NATION = table(
    "nation.csv",
    [
        {"name": "n_nationkey", "suppressOutput": True},
        {"name": "n_name", "propertyUrl": "rdfs:label"},
        {"name": "n_regionkey", "propertyUrl": "schema:containedInPlace", "valueUrl": BASE + "region/{n_regionkey}"},
    ],
    aboutUrl=BASE + "nation/{n_nationkey}",
)
_NATION_SQL = union(
    sql_triples("nation", "'http://example.org/nation/' || n_nationkey", "'http://www.w3.org/2000/01/rdf-schema#label'", "n_name"),
    sql_triples("nation", "'http://example.org/nation/' || n_nationkey", "'http://schema.org/containedInPlace'", "'http://example.org/region/' || n_regionkey", o_kind="iri"),
)


@_query(_NATION_SQL)
def minimal_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_frames(spark, {"nation.csv": load(spark, sf_dir, "nation")}, NATION).triples()


@_query(union(*[sql_triples("region", "'http://example.org/region/' || r_regionkey", f"'http://example.org/region.csv#{c}'", f"CAST({c} AS VARCHAR)", datatype=XSD + t) for c, t in (("r_regionkey", "integer"), ("r_name", "string"))]))
def minimal_region_default_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table("region.csv", [{"name": "r_regionkey", "datatype": "integer"}, {"name": "r_name"}], aboutUrl=BASE + "region/{r_regionkey}")
    return convert_frames(spark, {"region.csv": load(spark, sf_dir, "region")}, meta).triples()


_LINE = "'http://example.org/order/' || l_orderkey || '/' || l_linenumber"
LINEITEM = table(
    "lineitem.csv",
    [
        {"name": "l_orderkey", "datatype": "integer", "valueUrl": BASE + "order/{l_orderkey}"},
        {"name": "l_partkey", "datatype": "integer", "valueUrl": BASE + "part/{l_partkey}"},
        {"name": "l_suppkey", "datatype": "integer", "valueUrl": BASE + "supplier/{l_suppkey}"},
        {"name": "l_linenumber", "datatype": "integer"},
        {"name": "l_quantity", "datatype": "decimal"},
        {"name": "l_extendedprice", "datatype": "decimal"},
        {"name": "l_discount", "datatype": "decimal"},
        {"name": "l_tax", "datatype": "decimal"},
        {"name": "l_returnflag"},
        {"name": "l_linestatus"},
        {"name": "l_shipdate", "datatype": "date"},
    ],
    aboutUrl=BASE + "order/{l_orderkey}/{l_linenumber}",
)
_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"


@_query(
    union(
        *[sql_triples("lineitem", _LINE, f"'http://example.org/lineitem.csv#{c}'", f"'http://example.org/{k}/' || {c}", o_kind="iri") for c, k in (("l_orderkey", "order"), ("l_partkey", "part"), ("l_suppkey", "supplier"))],
        sql_triples("lineitem", _LINE, "'http://example.org/lineitem.csv#l_linenumber'", "CAST(l_linenumber AS VARCHAR)", datatype=XSD + "integer"),
        *[sql_triples("lineitem", _LINE, f"'http://example.org/lineitem.csv#{c}'", _MONEY.format(c), datatype=XSD + "decimal") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        *[sql_triples("lineitem", _LINE, f"'http://example.org/lineitem.csv#{c}'", c) for c in ("l_returnflag", "l_linestatus")],
        sql_triples("lineitem", _LINE, "'http://example.org/lineitem.csv#l_shipdate'", "strftime(l_shipdate, '%Y-%m-%d')", datatype=XSD + "date"),
    )
)
def minimal_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {c: F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")} | {c: money(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")} | {c: F.col(c) for c in ("l_returnflag", "l_linestatus")} | {"l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd")}
    return convert_frames(spark, {"lineitem.csv": load(spark, sf_dir, "lineitem", **cols)}, LINEITEM).triples()


@_query(union(*[sql_triples("(SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier)", "'_:s0_' || r", f"'http://example.org/supplier.csv#{c}'", o, s_kind="bnode") for c, o in (("s_suppkey", "CAST(s_suppkey AS VARCHAR)"), ("s_name", "s_name"))]))
def bnode_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = number_rows(load(spark, sf_dir, "supplier", s_suppkey=F.col("s_suppkey"), s_name=F.col("s_name")), "s_suppkey")
    return convert_frames(spark, {"supplier.csv": rows}, table("supplier.csv", [{"name": "s_suppkey"}, {"name": "s_name"}])).triples()


@_query(union(*[sql_triples("(SELECT *, row_number() OVER (ORDER BY r_regionkey) AS r FROM region)", "'_:s0_' || r", f"'http://example.org/region.csv#{c}'", f"CAST({c} AS VARCHAR)", s_kind="bnode") for c in ("r_regionkey", "r_name")]))
def schema_from_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = number_rows(load(spark, sf_dir, "region"), "r_regionkey")
    return convert_frames(spark, {"region.csv": rows}, {"url": BASE + "region.csv"}).triples()


# --- templates


@_query(
    union(
        sql_triples("lineitem", "'http://example.org/line/' || l_orderkey || ',' || l_linenumber", "'http://example.org/p/part'", "'http://example.org/parts#' || l_partkey || ',' || l_suppkey", o_kind="iri"),
        sql_triples("lineitem", "'http://example.org/line/' || l_orderkey || ',' || l_linenumber", "'http://example.org/p/flag'", "'http://example.org/flags#' || l_returnflag", o_kind="iri"),
    )
)
def template_multi_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {c: F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")}
    hidden = [{"name": c, "suppressOutput": True} for c in ("l_orderkey", "l_linenumber", "l_suppkey")]
    columns = [*hidden[:2], {"name": "l_partkey", "propertyUrl": BASE + "p/part", "valueUrl": BASE + "parts{#l_partkey,l_suppkey}"}, hidden[2], {"name": "l_returnflag", "propertyUrl": BASE + "p/flag", "valueUrl": BASE + "flags{#l_returnflag}"}]
    return convert_frames(spark, {"l": load(spark, sf_dir, "lineitem", **cols)}, table("l", columns, aboutUrl=BASE + "line/{l_orderkey,l_linenumber}")).triples()


_PART_ROWS = "(SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part)"


@_query(
    union(
        sql_triples(_PART_ROWS, "'http://example.org/part/row/' || r", "'http://example.org/part#p_name'", "'http://example.org/cell/' || r || '/1/p_name'", o_kind="iri"),
        sql_triples(_PART_ROWS, "'http://example.org/part/row/' || r", "'http://example.org/part#p_brand'", "'http://example.org/source/' || (r + 1) || '/2'", o_kind="iri"),
    )
)
def template_system_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = number_rows(load(spark, sf_dir, "part", p_partkey=F.col("p_partkey"), p_name=F.col("p_name"), p_brand=F.col("p_brand")), "p_partkey").drop("p_partkey").withColumn("_source_row", F.col("_row") + 1)
    columns = [{"name": "p_name", "valueUrl": BASE + "cell/{_row}/{_column}/{_name}"}, {"name": "p_brand", "valueUrl": BASE + "source/{_sourceRow}/{_sourceColumn}"}]
    return convert_frames(spark, {"part": rows}, table("part", columns, aboutUrl=BASE + "part/row/{_row}")).triples()


@_query(
    union(
        sql_triples("orders", "'http://example.org/orders/' || o_orderkey", "'http://example.org/o#o_orderkey'", "CAST(o_orderkey AS VARCHAR)", datatype=XSD + "long"),
        sql_triples("orders", "'http://example.org/orders/' || o_orderkey", "'http://example.org/o#o_orderstatus'", "'http://example.org/status/' || o_orderstatus", o_kind="iri", where="o_orderstatus <> 'F'"),
    )
)
def template_unbound_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "o_orderkey", "datatype": "long"}, {"name": "o_orderstatus", "null": ["F"], "valueUrl": BASE + "status/{o_orderstatus}"}]
    return convert_frames(spark, {"o": load(spark, sf_dir, "orders", o_orderkey=F.col("o_orderkey"), o_orderstatus=F.col("o_orderstatus"))}, table("o", columns, aboutUrl=BASE + "orders/{o_orderkey}")).triples()


@_query(
    union(
        sql_triples("customer", "'http://example.org/data/customer/' || c_custkey", "'http://example.org/data/c.csv#c_name'", "c_name"),
        sql_triples("customer", "'http://example.org/data/customer/' || c_custkey", "'http://example.org/data/c.csv#c_nationkey'", "'http://example.org/data/c.csv#n' || c_nationkey", o_kind="iri"),
    )
)
def relative_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "c_custkey", "suppressOutput": True}, {"name": "c_name"}, {"name": "c_nationkey", "valueUrl": "#n{c_nationkey}"}]
    rows = load(spark, sf_dir, "customer", c_custkey=F.col("c_custkey"), c_name=F.col("c_name"), c_nationkey=F.col("c_nationkey"))
    return convert_frames(spark, {"c.csv": rows}, table("data/c.csv", columns, aboutUrl="customer/{c_custkey}")).triples()


@_query(sql_triples("part", "'http://example.org/part/' || replace(p_brand, '#', '%23') || '/' || replace(p_name, ' ', '%20')", "'http://example.org/part#p_partkey'", "CAST(p_partkey AS VARCHAR)", datatype=XSD + "integer"))
def template_percent_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "p_partkey", "datatype": "integer"}, {"name": "p_name", "suppressOutput": True}, {"name": "p_brand", "suppressOutput": True}]
    rows = load(spark, sf_dir, "part", p_partkey=F.col("p_partkey"), p_name=F.col("p_name"), p_brand=F.col("p_brand"))
    return convert_frames(spark, {"part": rows}, table("part", columns, aboutUrl=BASE + "part/{p_brand}/{p_name}")).triples()


# --- nulls, defaults, virtual and suppressed columns


@_query(union(sql_triples("orders", "'http://example.org/o/' || o_orderkey", "'http://example.org/o#o_orderstatus'", "nullif(o_orderstatus, 'F')"), sql_triples("orders", "'http://example.org/o/' || o_orderkey", "'http://example.org/o#o_orderpriority'", "CASE WHEN o_orderpriority NOT IN ('5-LOW', '1-URGENT') THEN o_orderpriority END")))
def null_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "o_orderkey", "suppressOutput": True}, {"name": "o_orderstatus", "null": "F"}, {"name": "o_orderpriority", "null": ["5-LOW", "1-URGENT"]}]
    rows = load(spark, sf_dir, "orders", **{c["name"]: F.col(c["name"]) for c in columns})
    return convert_frames(spark, {"o": rows}, table("o", columns, aboutUrl=BASE + "o/{o_orderkey}")).triples()


@_query(union(sql_triples("orders", "'http://example.org/o/' || o_orderkey", "'http://example.org/o#o_orderstatus'", "nullif(o_orderstatus, 'P')", lang="en"), sql_triples("orders", "'http://example.org/o/' || o_orderkey", "'http://example.org/o#o_orderpriority'", "o_orderpriority", lang="de")))
def inherited_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "o_orderkey", "suppressOutput": True}, {"name": "o_orderstatus"}, {"name": "o_orderpriority", "lang": "de"}]
    rows = load(spark, sf_dir, "orders", **{c["name"]: F.col(c["name"]) for c in columns})
    one = table("o", columns) | {"aboutUrl": BASE + "o/{o_orderkey}"}
    return convert_frames(spark, {"o": rows}, {"null": ["P"], "lang": "en", "tables": [one]}).triples()


@_query(sql_triples("events", "'http://example.org/e/' || event_id", "'http://example.org/e#event_type'", "CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END"))
def default_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events", event_id=F.col("event_id"), event_type=F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")))
    return convert_frames(spark, {"e": rows}, table("e", [{"name": "event_id", "suppressOutput": True}, {"name": "event_type", "default": "none"}], aboutUrl=BASE + "e/{event_id}")).triples()


@_query(
    union(
        sql_triples("nation", "'http://example.org/nation/' || n_nationkey", "'http://example.org/n#n_name'", "n_name"),
        sql_triples("nation", "'http://example.org/nation/' || n_nationkey", f"'{RDF}type'", "'http://schema.org/Country'", o_kind="iri"),
        sql_triples("nation", "'http://example.org/nation/' || n_nationkey", "'http://example.org/p/source'", "'tpch'"),
    )
)
def virtual_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "n_nationkey", "suppressOutput": True}, {"name": "n_name"}, {"name": "kind", "virtual": True, "propertyUrl": "rdf:type", "valueUrl": "schema:Country"}, {"name": "src", "virtual": True, "propertyUrl": BASE + "p/source", "default": "tpch"}]
    rows = load(spark, sf_dir, "nation", n_nationkey=F.col("n_nationkey"), n_name=F.col("n_name"))
    return convert_frames(spark, {"n": rows}, table("n", columns, aboutUrl=BASE + "nation/{n_nationkey}")).triples()


@_query(sql_triples("supplier", "'http://example.org/supplier/' || s_suppkey", "'http://example.org/supplier#s_name'", "s_name"))
def suppress_output_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": c, "suppressOutput": c != "s_name"} for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")]
    return convert_frames(spark, {"supplier": load(spark, sf_dir, "supplier")}, table("supplier", columns, aboutUrl=BASE + "supplier/{s_suppkey}")).triples()


@_query(sql_triples("region", "'http://example.org/region/' || r_regionkey", "'http://example.org/region#r_name'", "r_name"))
def suppress_output_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [
        table("nation", [{"name": c} for c in ("n_nationkey", "n_name", "n_regionkey")], suppressOutput=True),
        table("region", [{"name": "r_regionkey", "suppressOutput": True}, {"name": "r_name"}], aboutUrl=BASE + "region/{r_regionkey}"),
    ]
    return convert_frames(spark, {t: load(spark, sf_dir, t) for t in ("nation", "region")}, {"tables": tables}).triples()


# --- lists and white space


@_query(sql_triples("(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)", "'http://example.org/part/' || p_partkey", "'http://example.org/part#p_name'", "w"))
def list_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "p_partkey", "suppressOutput": True}, {"name": "p_name", "separator": " "}]
    rows = load(spark, sf_dir, "part", p_partkey=F.col("p_partkey"), p_name=F.col("p_name"))
    return convert_frames(spark, {"part": rows}, table("part", columns, aboutUrl=BASE + "part/{p_partkey}")).triples()


_WORDS = "(SELECT r, len(ws) AS n, unnest(range(0, len(ws))) AS k, ws FROM (SELECT string_split(p_name, ' ') AS ws, row_number() OVER (ORDER BY p_partkey) AS r FROM part))"


@_query(
    union(
        sql_triples("(SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part)", "'http://example.org/part/' || p_partkey", "'http://example.org/part#p_name'", "'_:l0_1_' || r || '_0'", o_kind="bnode"),
        sql_triples(_WORDS, "'_:l0_1_' || r || '_' || k", f"'{RDF}first'", "ws[k + 1]", s_kind="bnode"),
        sql_triples(_WORDS, "'_:l0_1_' || r || '_' || k", f"'{RDF}rest'", "'_:l0_1_' || r || '_' || (k + 1)", s_kind="bnode", o_kind="bnode", where="k + 1 < n"),
        sql_triples(_WORDS, "'_:l0_1_' || r || '_' || k", f"'{RDF}rest'", f"'{RDF}nil'", s_kind="bnode", o_kind="iri", where="k + 1 = n"),
    )
)
def list_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "p_partkey", "suppressOutput": True}, {"name": "p_name", "separator": " ", "ordered": True}]
    rows = number_rows(load(spark, sf_dir, "part", p_partkey=F.col("p_partkey"), p_name=F.col("p_name")), "p_partkey")
    return convert_frames(spark, {"part": rows}, table("part", columns, aboutUrl=BASE + "part/{p_partkey}")).triples()


def _documents(spark: SparkSession, sf_dir: str, datatype: str) -> DataFrame:
    columns = [{"name": "doc_id", "suppressOutput": True}, {"name": "text", "datatype": datatype}]
    rows = load(spark, sf_dir, "documents", doc_id=F.col("doc_id"), text=F.col("text"))
    return convert_frames(spark, {"documents": rows}, table("documents", columns, aboutUrl=BASE + "doc/{doc_id}")).triples()


_DOC = "'http://example.org/doc/' || doc_id"


@_query(sql_triples("documents", _DOC, "'http://example.org/documents#text'", "nullif(regexp_replace(trim(translate(text, chr(13) || chr(10) || chr(9), '   ')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '')", datatype=XSD + "token"))
def whitespace_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "token")


@_query(sql_triples("documents", _DOC, "'http://example.org/documents#text'", "nullif(translate(text, chr(13) || chr(10) || chr(9), '   '), '')", datatype=XSD + "normalizedString"))
def whitespace_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "normalizedString")


@_query(sql_triples("documents", _DOC, "'http://example.org/documents#text'", "nullif(text, '')"))
def whitespace_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "string")


# --- formats


def _one(spark: SparkSession, frame: DataFrame, key: str, column: dict) -> DataFrame:
    return convert_frames(spark, {"t": frame}, table("t", [{"name": key, "suppressOutput": True}, column], aboutUrl=BASE + f"t/{{{key}}}")).triples()


@_query(sql_triples("labels", "'http://example.org/t/' || doc_id", "'http://example.org/t#quality'", "CASE quality WHEN 1 THEN 'true' WHEN 0 THEN 'false' END", datatype=XSD + "boolean"))
def boolean_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels", doc_id=F.col("doc_id"), quality=F.when(F.col("quality") == 1, F.lit("Good")).otherwise(F.lit("Bad")))
    return _one(spark, rows, "doc_id", {"name": "quality", "datatype": {"base": "boolean", "format": "Good|Bad"}})


@_query(sql_triples("orders", "'http://example.org/t/' || o_orderkey", "'http://example.org/t#price'", _MONEY.format("o_totalprice"), datatype=XSD + "decimal"))
def number_format_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders", o_orderkey=F.col("o_orderkey"), price=F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    return _one(spark, rows, "o_orderkey", {"name": "price", "datatype": {"base": "decimal", "format": "#,##0.00"}})


@_query(sql_triples("customer", "'http://example.org/t/' || c_custkey", "'http://example.org/t#balance'", _MONEY.format("c_acctbal"), datatype=XSD + "decimal"))
def number_format_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    european = F.translate(F.format_number(F.col("c_acctbal").cast("decimal(18,2)"), 2), ",.", ".,")
    return _one(spark, load(spark, sf_dir, "customer", c_custkey=F.col("c_custkey"), balance=european), "c_custkey", {"name": "balance", "datatype": {"base": "decimal", "format": {"pattern": "#.##0,00", "decimalChar": ",", "groupChar": "."}}})


@_query(sql_triples("(SELECT DISTINCT CAST(round(l_discount * 100) AS INTEGER) AS d FROM lineitem)", "'http://example.org/t/' || d", "'http://example.org/t#rate'", "regexp_replace(regexp_replace(CAST(CAST(d AS DECIMAL(5,2)) / 100 AS DECIMAL(5,2))::VARCHAR, '0+$', ''), '\\.$', '')", datatype=XSD + "decimal"))
def number_format_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.round(F.col("l_discount") * 100).cast("int")
    rows = load(spark, sf_dir, "lineitem", d=d).distinct().withColumn("rate", F.concat(F.col("d").cast("string"), F.lit("%")))
    return _one(spark, rows, "d", {"name": "rate", "datatype": {"base": "decimal", "format": "#0%"}})


@_query(sql_triples("orders", "'http://example.org/t/' || o_orderkey", "'http://example.org/t#day'", "strftime(o_orderdate, '%Y-%m-%d')", datatype=XSD + "date"))
def date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders", o_orderkey=F.col("o_orderkey"), day=F.date_format("o_orderdate", "d.M.yyyy"))
    return _one(spark, rows, "o_orderkey", {"name": "day", "datatype": {"base": "date", "format": "d.M.yyyy"}})


@_query(sql_triples("events", "'http://example.org/t/' || event_id", "'http://example.org/t#at'", "regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '(\\.0+|(\\.[0-9]*[1-9])0+)$', '\\2') || '+05:30'", datatype=XSD + "dateTime"))
def datetime_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events", event_id=F.col("event_id"), at=F.concat(F.date_format("ts", "dd/MM/yyyy HH:mm:ss.SSSSSS"), F.lit("+0530")))
    return _one(spark, rows, "event_id", {"name": "at", "datatype": {"base": "datetime", "format": "dd/MM/yyyy HH:mm:ss.SSSSSSX"}})


@_query(sql_triples("events", "'http://example.org/t/' || event_id", "'http://example.org/t#at'", "strftime(ts, '%H:%M:00') || 'Z'", datatype=XSD + "time"))
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events", event_id=F.col("event_id"), at=F.concat(F.date_format("ts", "HHmm"), F.lit("+00")))
    return _one(spark, rows, "event_id", {"name": "at", "datatype": {"base": "time", "format": "HHmmx"}})


@_query(sql_triples("benchmark", "'http://example.org/t/' || item_id", "'http://example.org/t#text'", "nullif(text, '')", lang="en"))
def lang_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, load(spark, sf_dir, "benchmark", item_id=F.col("item_id"), text=F.col("text")), "item_id", {"name": "text", "lang": "en"})


@_query(sql_triples("part", "'http://example.org/t/' || p_partkey", "'http://example.org/t#p_brand'", "p_brand", datatype=BASE + "Brand"))
def datatype_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, load(spark, sf_dir, "part", p_partkey=F.col("p_partkey"), p_brand=F.col("p_brand")), "p_partkey", {"name": "p_brand", "datatype": {"@id": BASE + "Brand", "base": "string"}})


_XSD_NAMES = "anyAtomicType anyURI base64Binary boolean byte date dateTime dateTimeStamp dayTimeDuration decimal double duration float gDay gMonth gMonthDay gYear gYearMonth hexBinary int integer language long Name negativeInteger NMTOKEN nonNegativeInteger nonPositiveInteger normalizedString positiveInteger QName short string time token unsignedByte unsignedInt unsignedLong unsignedShort yearMonthDuration".split()
_OTHER_NAMES = {"any": XSD + "anyAtomicType", "binary": XSD + "base64Binary", "datetime": XSD + "dateTime", "html": RDF + "HTML", "json": CSVW + "JSON", "langString": RDF + "langString", "number": XSD + "double", "xml": RDF + "XMLLiteral"}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{i}')" for n, i in [*((n, XSD + n) for n in _XSD_NAMES), *_OTHER_NAMES.items()]) + ") AS v(name, iri)")
def datatype_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d.name, d.iri) for d in REGISTRY.values()], "name string, iri string")


# --- groups, structure, sets


def _two(name: str, key: str, label: str) -> dict:
    return table(name, [{"name": key, "suppressOutput": True}, {"name": label, "propertyUrl": "rdfs:label"}], aboutUrl=BASE + f"{name}/{{{key}}}")


_GROUP = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))


@_query(union(*[sql_triples(t, f"'http://example.org/{t}/' || {k}", "'http://www.w3.org/2000/01/rdf-schema#label'", n) for t, k, n in _GROUP]))
def union_table_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {t: load(spark, sf_dir, t, **{k: F.col(k), n: F.col(n)}) for t, k, n in _GROUP}
    return convert_frames(spark, frames, {"tables": [_two(*g) for g in _GROUP]}).triples()


_REGION_ROWS = "(SELECT *, row_number() OVER (ORDER BY r_regionkey) AS r FROM region)"


def _standard_sql(title: bool) -> str:
    parts = [
        f"SELECT * FROM (VALUES ('_:g0', 'bnode', '{RDF}type', '{CSVW}TableGroup', 'iri', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)), ('_:g0', 'bnode', '{CSVW}table', '_:t0', 'bnode', NULL, NULL), ('_:t0', 'bnode', '{RDF}type', '{CSVW}Table', 'iri', NULL, NULL), ('_:t0', 'bnode', '{CSVW}url', 'http://example.org/region', 'iri', NULL, NULL)) AS v(s, s_kind, p, o, o_kind, o_datatype, o_lang)",
        sql_triples(_REGION_ROWS, "'_:t0'", f"'{CSVW}row'", "'_:r0_' || r", s_kind="bnode", o_kind="bnode"),
        sql_triples(_REGION_ROWS, "'_:r0_' || r", f"'{RDF}type'", f"'{CSVW}Row'", s_kind="bnode", o_kind="iri"),
        sql_triples(_REGION_ROWS, "'_:r0_' || r", f"'{CSVW}rownum'", "CAST(r AS VARCHAR)", s_kind="bnode", datatype=XSD + "integer"),
        sql_triples(_REGION_ROWS, "'_:r0_' || r", f"'{CSVW}url'", "'http://example.org/region#row=' || (r + 1)", s_kind="bnode", o_kind="iri"),
        sql_triples(_REGION_ROWS, "'_:r0_' || r", f"'{CSVW}describes'", "'http://example.org/region/' || r_regionkey", s_kind="bnode", o_kind="iri"),
        sql_triples("region", "'http://example.org/region/' || r_regionkey", "'http://www.w3.org/2000/01/rdf-schema#label'", "r_name"),
    ]
    if title:
        parts.append(sql_triples(_REGION_ROWS, "'_:r0_' || r", f"'{CSVW}title'", "r_name", s_kind="bnode"))
    return union(*parts)


def _standard(spark: SparkSession, sf_dir: str, meta: dict) -> DataFrame:
    rows = number_rows(load(spark, sf_dir, "region"), "r_regionkey").withColumn("_source_row", F.col("_row") + 1)
    return convert_frames(spark, {"region": rows}, meta, standard=True).triples()


@_query(_standard_sql(False))
def standard_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standard(spark, sf_dir, _two("region", "r_regionkey", "r_name"))


@_query(_standard_sql(True))
def row_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _two("region", "r_regionkey", "r_name")
    return _standard(spark, sf_dir, meta | {"tableSchema": meta["tableSchema"] | {"rowTitles": "r_name"}})


@_query()
def common_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _two("region", "r_regionkey", "r_name") | {"dc:title": [{"@value": "Regions", "@language": "en"}, {"@value": "Regionen", "@language": "de"}], "dcat:keyword": ["world", "parts"], "dc:issued": {"@value": "2026-01-01", "@type": "xsd:date"}, "schema:size": 5, "schema:rate": 0.5, "schema:open": True, "dc:publisher": {"schema:name": "Example", "schema:url": {"@id": BASE}}, "notes": [{"schema:text": "a note"}]}
    return _standard(spark, sf_dir, meta)


@_query("SELECT DISTINCT * FROM (" + sql_triples("orders", "'http://example.org/customer/' || o_custkey", f"'{RDF}type'", "'http://schema.org/Person'", o_kind="iri") + ")")
def distinct_triples_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "o_custkey", "propertyUrl": "rdf:type", "valueUrl": "schema:Person"}]
    rows = load(spark, sf_dir, "orders", o_custkey=F.col("o_custkey"))
    return distinct_triples(convert_frames(spark, {"o": rows}, table("o", columns, aboutUrl=BASE + "customer/{o_custkey}")).triples())


@_query("SELECT 'http://example.org/nation/' || n_nationkey AS s, n_name AS label, 'http://example.org/region/' || n_regionkey AS region FROM nation")
def triples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_back(minimal_nation(spark, sf_dir), {"label": "http://www.w3.org/2000/01/rdf-schema#label", "region": "http://schema.org/containedInPlace"})


@_query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def linked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = minimal_nation(spark, sf_dir)
    regions = convert_frames(spark, {"region": load(spark, sf_dir, "region")}, _two("region", "r_regionkey", "r_name")).triples()
    label = F.col("p") == "http://www.w3.org/2000/01/rdf-schema#label"
    names = nations.filter(label).select("s", F.col("o").alias("nation"))
    places = nations.filter(F.col("p") == "http://schema.org/containedInPlace").select("s", F.col("o").alias("r"))
    return names.join(places, "s").join(regions.filter(label).select(F.col("s").alias("r"), F.col("o").alias("region")), "r").select("nation", "region")


@_query(f"SELECT *, 'left' AS side FROM ({_NATION_SQL}) WHERE o_kind = 'iri'")
def graph_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = minimal_nation(spark, sf_dir)
    return sinks.difference(whole, whole.filter("o_kind = 'literal'"))


# --- validation


def _errors(spark: SparkSession, frame: DataFrame, columns: list[dict], **schema) -> DataFrame:
    meta = {"url": BASE + "t", "tableSchema": {"columns": columns} | schema}
    return convert_frames(spark, {"t": frame}, meta).errors()


def _error_sql(source: str, row: str, column: str, kind: str, value: str, where: str) -> str:
    return f"SELECT 'http://example.org/t' AS \"table\", {row} AS \"row\", '{column}' AS \"column\", '{kind}' AS kind, {value} AS value FROM {source} WHERE {where}"


@_query(_error_sql("events", "CAST(event_id AS VARCHAR)", "event_type", "required", "''", "event_type = 'error'"))
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events", event_type=F.when(F.col("event_type") != "error", F.col("event_type")), _row=F.col("event_id"))
    return _errors(spark, rows, [{"name": "event_type", "required": True}])


@_query(union(_error_sql("lineitem", "CAST(l_orderkey AS VARCHAR)", "l_quantity", "maxInclusive", _MONEY.format("l_quantity"), "l_quantity > 40"), _error_sql("lineitem", "CAST(l_orderkey AS VARCHAR)", "l_discount", "minExclusive", _MONEY.format("l_discount"), "CAST(l_discount AS DECIMAL(18,2)) <= 0.02")))
def validate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem", l_quantity=money("l_quantity"), l_discount=money("l_discount"), _row=F.col("l_orderkey"))
    return _errors(spark, rows, [{"name": "l_quantity", "datatype": {"base": "decimal", "maximum": 40}}, {"name": "l_discount", "datatype": {"base": "decimal", "minExclusive": 0.02}}])


@_query(union(_error_sql("documents", "CAST(doc_id AS VARCHAR)", "source", "minLength", "source", "length(source) < 5"), _error_sql("documents", "CAST(doc_id AS VARCHAR)", "lang", "length", "lang", "length(lang) <> 3")))
def validate_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents", source=F.col("source"), lang=F.col("lang"), _row=F.col("doc_id"))
    return _errors(spark, rows, [{"name": "source", "datatype": {"base": "string", "minLength": 5}}, {"name": "lang", "datatype": {"base": "string", "length": 3}}])


@_query(union(_error_sql("part", "CAST(p_partkey AS VARCHAR)", "p_brand", "format", "p_brand", "NOT regexp_full_match(p_brand, 'Brand#[0-9]')"), _error_sql("part", "CAST(p_partkey AS VARCHAR)", "p_size", "datatype", "CAST(p_size AS VARCHAR)", "p_size > 127"), _error_sql("part", "CAST(p_partkey AS VARCHAR)", "p_type", "datatype", "p_type", "p_type NOT IN ('true', 'false', '1', '0')")))
def validate_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part", p_brand=F.col("p_brand"), p_size=F.col("p_size"), p_type=F.col("p_type"), _row=F.col("p_partkey"))
    return _errors(spark, rows, [{"name": "p_brand", "datatype": {"base": "string", "format": "Brand#[0-9]"}}, {"name": "p_size", "datatype": "byte"}, {"name": "p_type", "datatype": "boolean"}])


@_query("SELECT 'http://example.org/t' AS \"table\", CAST(NULL AS VARCHAR) AS \"row\", 'l_orderkey|l_linenumber' AS \"column\", 'primaryKey' AS kind, l_orderkey || '|' || l_linenumber AS value FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def validate_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem", l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"))
    return _errors(spark, rows, [{"name": "l_orderkey"}, {"name": "l_linenumber"}], primaryKey=["l_orderkey", "l_linenumber"])


@_query("SELECT 'http://example.org/orders' AS \"table\", CAST(o_orderkey AS VARCHAR) AS \"row\", 'o_custkey' AS \"column\", 'foreignKey' AS kind, CAST(o_custkey AS VARCHAR) AS value FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')")
def validate_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders", o_custkey=F.col("o_custkey"), _row=F.col("o_orderkey"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_mktsegment <> 'BUILDING'").select("c_custkey")
    key = {"columnReference": "o_custkey", "reference": {"resource": BASE + "customer", "columnReference": "c_custkey"}}
    tables = [{"url": BASE + "orders", "tableSchema": {"columns": [{"name": "o_custkey"}], "foreignKeys": [key]}}, {"url": BASE + "customer", "tableSchema": {"columns": [{"name": "c_custkey"}]}}]
    return convert_frames(spark, {"orders": orders, "customer": customers}, {"tables": tables}).errors()


# --- files and streams


@_query("SELECT '<http://example.org/nation/' || n_nationkey || '> <http://www.w3.org/2000/01/rdf-schema#label> \"' || n_name || '\" .' AS value FROM nation UNION ALL SELECT '<http://example.org/nation/' || n_nationkey || '> <http://schema.org/containedInPlace> <http://example.org/region/' || n_regionkey || '> .' FROM nation")
def ntriples_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    sinks.write_ntriples(minimal_nation(spark, sf_dir), path)
    return spark.read.text(path)


@_query(_NATION_SQL)
def ntriples_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    sinks.write_ntriples(minimal_nation(spark, sf_dir), path)
    return sinks.read_ntriples(spark, path)


_TEXT_SQL = sql_triples("documents", _DOC, "'http://example.org/documents#text'", "nullif(text, '')")


@_query(_TEXT_SQL)
def ntriples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, backslashes and line ends, written as N-Triples and read again."""
    path = shared_folder(spark)
    sinks.write_ntriples(whitespace_string(spark, sf_dir), path)
    return sinks.read_ntriples(spark, path)


_TURTLE_TEXT = "replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"


@_query(
    f"SELECT '<' || {_DOC} || '> <http://example.org/documents#text> \"' || {_TURTLE_TEXT} || '\"^^xsd:token .' AS value FROM (SELECT doc_id, 'see <{XSD}date> ' || trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM documents WHERE trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> '')"
    f" UNION ALL SELECT '<' || {_DOC} || '> rdf:type <http://example.org/Doc> .' FROM documents WHERE trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> ''"
)
def turtle_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle lines; a literal that quotes an IRI in angle brackets stays as it is."""
    path = shared_folder(spark)
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = load(spark, sf_dir, "documents", doc_id=F.col("doc_id"), text=F.concat(F.lit(f"see <{XSD}date> "), F.when(text != "", text))).dropna(subset=["text"])
    columns = [{"name": "doc_id", "suppressOutput": True}, {"name": "text", "datatype": "token"}, {"name": "kind", "virtual": True, "propertyUrl": "rdf:type", "valueUrl": BASE + "Doc"}]
    found = convert_frames(spark, {"documents": rows}, table("documents", columns, aboutUrl=BASE + "doc/{doc_id}")).triples()
    sinks.turtle(found).write.text(path)
    return spark.read.text(path)


@_query(_NATION_SQL)
def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    sinks.write_parquet(minimal_nation(spark, sf_dir), path)
    return sinks.read_parquet(spark, path)


@_query(union(*[sql_triples(_REGION_ROWS, "'http://example.org/r/' || r || '/' || (r + 1)", f"'http://example.org/region.csv#{c}'", f"CAST({c} AS VARCHAR)") for c in ("r_regionkey", "r_name")]))
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    load(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1).write.option("header", "true").csv(path)
    meta = {"url": BASE + "region.csv", "aboutUrl": BASE + "r/{_row}/{_sourceRow}"}
    return convert_group(spark, parse_metadata(meta, BASE), base=BASE, resolver=MemoryResolver({}, {BASE + "region.csv": path})).triples()


@_query(
    "SELECT * FROM (VALUES " + ", ".join(f"('http://example.org/d/{r}', 'iri', 'http://example.org/d.csv#{c}', '{v}', 'literal', '{XSD}string', CAST(NULL AS VARCHAR))" for r, c, v in ((1, "a", "1"), (1, "b", "x;y"), (2, "a", "2"), (2, "b", 'say "hi"'), (2, "_col.3", "more"))) + ") AS v(s, s_kind, p, o, o_kind, o_datatype, o_lang)"
)
def csv_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    lines = ["skipped line", "a;b", "# a comment", "1 ;'x;y'", ";", "2;say \"hi\" ;more"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    meta = {"url": BASE + "d.csv", "aboutUrl": BASE + "d/{_row}", "dialect": {"delimiter": ";", "quoteChar": "'", "skipRows": 1, "trim": True, "skipBlankRows": True}}
    return convert_group(spark, parse_metadata(meta, BASE), base=BASE, resolver=MemoryResolver({}, {BASE + "d.csv": path})).triples()


@_query(_NATION_SQL)
def streaming_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    nations = load(spark, sf_dir, "nation")
    nations.write.parquet(path + "/in")  # a stream reads a folder
    rows = spark.readStream.schema(nations.schema).parquet(path + "/in")
    run = stream_triples(rows, NATION).writeStream.format("parquet").option("path", path + "/out").option("checkpointLocation", path + "/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(path + "/out")
