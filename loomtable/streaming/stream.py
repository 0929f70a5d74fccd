"""Streams of rows to streams of triples: making triples keeps no state, so the batch plan serves as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.triples import COLUMNS, TableCompiler
from ..plans.metadata import MetadataError, parse_metadata
from ..plans.model import TableGroup


def stream_triples(rows: DataFrame, metadata: str | dict | TableGroup, *, base: str = "http://example.org/", string_datatype: bool = True, distinct_by: tuple[str, str] | None = None) -> DataFrame:
    """Triples (minimal form) of a streaming frame under a description of one table.

    A stream has no row numbers: subjects and templates must come from values. distinct_by names a
    time column and a delay; triples repeated within it are dropped, with bounded state.
    """
    group = metadata if isinstance(metadata, TableGroup) else parse_metadata(metadata, base)
    if len(group.tables) != 1:
        raise MetadataError("a stream is described by one table")
    frame = rows if not distinct_by else rows.withWatermark(*distinct_by)
    compiler = TableCompiler(group, group.tables[0], frame, aside=distinct_by[:1] if distinct_by else ())
    single, many = compiler.cell_structs()
    every = F.concat(F.array(*single), *many) if many else F.array(*single)
    kept = [F.explode(every).alias("t")] + ([F.col(distinct_by[0]).alias("_time")] if distinct_by else [])
    out = compiler.staged.select(*kept).select("t.*", *(["_time"] if distinct_by else []))
    out = out.filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    if distinct_by:
        out = out.dropDuplicatesWithinWatermark(list(COLUMNS)).select(*COLUMNS)
    return out
