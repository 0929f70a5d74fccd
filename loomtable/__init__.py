"""Annotated tables on Spark: CSV files and frames, described in JSON, become typed, linked triples and errors."""

from .convert import Conversion, convert, convert_frames, convert_group
from .operators.triples import TableCompiler, distinct_triples, pivot_back
from .operators.validate import validate_group
from .plans.metadata import MetadataError, parse_metadata

__all__ = ["Conversion", "MetadataError", "TableCompiler", "convert", "convert_frames", "convert_group", "distinct_triples", "parse_metadata", "pivot_back", "validate_group"]
