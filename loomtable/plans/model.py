"""The declarative program: table groups, tables, columns, dialects and datatypes, with inheritance resolved."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class NumericFormat:
    pattern: str | None = None
    decimal_char: str = "."
    group_char: str = ","


@dataclass
class Datatype:
    base: str = "string"
    id: str | None = None
    format: str | NumericFormat | None = None
    #: minimum, minInclusive, minExclusive, maximum, ..., length, minLength, maxLength
    constraints: dict[str, Any] = field(default_factory=dict)


@dataclass
class Dialect:
    comment_prefix: str | None = "#"
    delimiter: str = ","
    double_quote: bool = True
    encoding: str = "utf-8"
    header: bool = True
    header_row_count: int | None = None
    line_terminators: tuple[str, ...] = ("\r\n", "\n")
    quote_char: str | None = '"'
    skip_blank_rows: bool = False
    skip_columns: int = 0
    skip_initial_space: bool = False
    skip_rows: int = 0
    #: "true", "false", "start" or "end"
    trim: str = "false"

    @property
    def header_rows(self) -> int:
        return self.header_row_count if self.header_row_count is not None else int(self.header)


#: Properties that a column takes from its schema, its table and its group, and their last defaults.
INHERITED: dict[str, Any] = {"aboutUrl": None, "propertyUrl": None, "valueUrl": None, "datatype": Datatype(), "default": "", "lang": None, "null": ("",), "separator": None, "ordered": False, "required": False, "textDirection": None}


@dataclass
class Column:
    name: str
    titles: dict[str, list[str]] = field(default_factory=dict)
    virtual: bool = False
    suppress_output: bool = False
    props: dict[str, Any] = field(default_factory=dict)
    common: dict[str, Any] = field(default_factory=dict)


@dataclass
class ForeignKey:
    columns: tuple[str, ...]
    resource: str | None
    schema_reference: str | None
    references: tuple[str, ...]


@dataclass
class Schema:
    #: None: the header supplies the columns
    columns: list[Column] | None = None
    props: dict[str, Any] = field(default_factory=dict)
    primary_key: tuple[str, ...] = ()
    row_titles: tuple[str, ...] = ()
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    id: str | None = None
    common: dict[str, Any] = field(default_factory=dict)


@dataclass
class Table:
    url: str
    id: str | None = None
    schema: Schema = field(default_factory=Schema)
    dialect: Dialect | None = None
    suppress_output: bool = False
    props: dict[str, Any] = field(default_factory=dict)
    common: dict[str, Any] = field(default_factory=dict)
    notes: list[Any] = field(default_factory=list)


@dataclass
class TableGroup:
    tables: list[Table] = field(default_factory=list)
    id: str | None = None
    dialect: Dialect | None = None
    props: dict[str, Any] = field(default_factory=dict)
    common: dict[str, Any] = field(default_factory=dict)
    notes: list[Any] = field(default_factory=list)
    language: str = "und"
    warnings: list[str] = field(default_factory=list)


def effective(group: TableGroup, table: Table, column: Column) -> dict[str, Any]:
    """The inherited properties of a column: its own, else its schema's, table's or group's, else the default."""
    return INHERITED | group.props | table.props | table.schema.props | column.props


def dialect_of(group: TableGroup, table: Table) -> Dialect:
    """A table's dialect replaces its group's as a whole."""
    return table.dialect or group.dialect or Dialect()
