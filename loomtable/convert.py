"""Front doors: a CSV file, a description, or any frames with a description, to triples and errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.annotations import structure
from .operators.triples import SCHEMA, TableCompiler, distinct_triples
from .operators.validate import validate_group
from .plans.metadata import MetadataError, check_header, parse_metadata
from .plans.model import TableGroup, dialect_of
from .sources import discovery
from .sources.csv import read_csv
from .sources.discovery import Resolver, SparkResolver, json_loader


@dataclass
class Conversion:
    """A compiled group. triples and errors are lazy frames; problems were found while compiling."""

    spark: SparkSession
    group: TableGroup
    compilers: list[TableCompiler]
    base: str
    standard: bool
    problems: list[str] = field(default_factory=list)
    #: by table: the records that have fewer fields than the widest
    ragged: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def warnings(self) -> list[str]:
        return self.group.warnings

    def triples(self, distinct: bool = False) -> DataFrame:
        frames = [c.triples(self.standard) for c in self.compilers if not c.table.suppress_output]
        if self.standard:
            frames.insert(0, structure(self.spark, self.group, self.base))
        if not frames:
            return self.spark.createDataFrame([], SCHEMA)
        out = reduce(lambda a, b: a.unionByName(b), frames)
        return distinct_triples(out) if distinct else out

    def errors(self) -> DataFrame:
        """Faults of cells and keys, and of files the short records (kind `fields`: how many there are); their row is the
        number in the source, as such records needn't be rows."""
        short = [r.select(F.lit(url).alias("table"), F.col("_source_row").cast("string").alias("row"), F.lit(None).cast("string").alias("column"), F.lit("fields").alias("kind"), F.col("fields").cast("string").alias("value")) for url, r in self.ragged.items()]
        return reduce(lambda a, b: a.unionByName(b), short, validate_group(self.compilers))

    def views(self, prefix: str = "") -> list[str]:
        """Registers each table's raw rows as a temporary view; the names."""
        names = []
        for c in self.compilers:
            name = prefix + c.table.url.rstrip("/").rsplit("/", 1)[-1].split(".")[0].replace("-", "_")
            c.frame.createOrReplaceTempView(name)
            names.append(name)
        return names


def convert_frames(spark: SparkSession, frames: dict[str, DataFrame], metadata: str | dict | TableGroup, *, base: str = "http://example.org/", standard: bool = False, string_datatype: bool = True, resolver: Callable[[str], Any] | None = None) -> Conversion:
    """Applies a description to frames by their table's URL (or its last part). Columns are taken as text.

    Frames that carry `_row` and `_source_row` keep them; templates without row numbers need neither.
    """
    group = metadata if isinstance(metadata, TableGroup) else parse_metadata(metadata, base, resolver)
    compilers = []
    for k, table in enumerate(group.tables):
        frame = frames.get(table.url, frames.get(table.url.rsplit("/", 1)[-1]))
        if frame is None:
            if table.suppress_output:
                continue
            raise MetadataError(f"there is no frame for {table.url}")
        compilers.append(TableCompiler(group, table, frame, k, string_datatype))
    return Conversion(spark, group, compilers, base, standard)


def convert_group(spark: SparkSession, group: TableGroup, *, base: str, resolver: Resolver | None = None, standard: bool = False, string_datatype: bool = True, splittable: bool = False) -> Conversion:
    """Reads every table that isn't suppressed (or that a foreign key refers to) and compiles it."""
    resolver = resolver or SparkResolver(spark)
    referred = {k.resource for t in group.tables for k in t.schema.foreign_keys} | {t.url for t in group.tables if t.schema.id and any(k.schema_reference == t.schema.id for u in group.tables for k in u.schema.foreign_keys)}
    compilers, problems, ragged = [], [], {}
    for k, table in enumerate(group.tables):
        if table.suppress_output and table.url not in referred:
            continue
        scan = read_csv(spark, resolver.path(table.url), dialect_of(group, table), splittable=splittable)
        if scan.header is not None:
            problems += [f"{table.url}: {p}" for p in check_header(table, scan.header, group.language)]
        compilers.append(TableCompiler(group, table, scan.rows, k, string_datatype))
        ragged[table.url] = scan.ragged
    return Conversion(spark, group, compilers, base, standard, problems, ragged)


def convert(spark: SparkSession, source: str, *, metadata: str | dict | None = None, link: str | None = None, resolver: Resolver | None = None, standard: bool = True, string_datatype: bool = True, splittable: bool = False) -> Conversion:
    """Converts a CSV file (its description is given, or looked for), or a description (its tables are read)."""
    resolver = resolver or SparkResolver(spark)
    how = {"resolver": resolver, "standard": standard, "string_datatype": string_datatype, "splittable": splittable}
    if metadata is not None:
        return convert_group(spark, parse_metadata(metadata, source, json_loader(resolver)), base=source, **how)
    if discovery.kind_of(source) == "json":
        text = resolver.text(source)
        if text is None:
            raise MetadataError(f"{source} isn't there")
        return convert_group(spark, parse_metadata(text, source, json_loader(resolver)), base=source, **how)
    found = discovery.locate(resolver, source, link)
    if found is None:
        return convert_group(spark, discovery.default_group(source), base=source, **how)
    place, text = found
    return convert_group(spark, parse_metadata(text, place, json_loader(resolver)), base=place, **how)


def observed(triples: DataFrame, name: str = "progress") -> tuple[DataFrame, Any]:
    """Triples with a counter that fills while they are written: (frame, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return triples.observe(seen, F.count(F.lit(1)).alias("triples")), seen
