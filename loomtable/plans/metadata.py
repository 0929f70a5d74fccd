"""Reads a JSON description into the model: normalisation, checks, warnings and fatal errors."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any
from urllib.parse import quote, urljoin

from ..functions.datatypes import REGISTRY
from .context import ABSOLUTE, expand_curie
from .model import Column, Datatype, Dialect, ForeignKey, NumericFormat, Schema, Table, TableGroup

#: The kind that `@type` must name, by where a description stands.
TYPES = ("TableGroup", "Table", "Schema", "Column", "Dialect", "Template")
LINKS = ("aboutUrl", "propertyUrl", "valueUrl")
#: The plain properties that each kind of description may have, beside the inherited ones.
INHERITED = ("aboutUrl", "datatype", "default", "lang", "null", "ordered", "propertyUrl", "required", "separator", "textDirection", "valueUrl")
PROPERTIES = {
    "TableGroup": ("@context", "@id", "@type", "dialect", "notes", "tableDirection", "tableSchema", "tables", "transformations"),
    "Table": ("@context", "@id", "@type", "dialect", "notes", "suppressOutput", "tableDirection", "tableSchema", "transformations", "url"),
    "Schema": ("@context", "@id", "@type", "columns", "foreignKeys", "primaryKey", "rowTitles"),
    "Column": ("@id", "@type", "name", "suppressOutput", "titles", "virtual"),
}
LIMITS = ("minimum", "maximum", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive")
LENGTHS = ("length", "minLength", "maxLength")

#: Language tags: language, script, region, variants, extensions, private use; and the irregular ones.
_LANGUAGE = re.compile(r"^(([A-Za-z]{2,3}(-[A-Za-z]{3}){0,3}|[A-Za-z]{4,8})(-[A-Za-z]{4})?(-([A-Za-z]{2}|\d{3}))?(-([A-Za-z0-9]{5,8}|\d[A-Za-z0-9]{3}))*(-[0-9A-WY-Za-wy-z](-[A-Za-z0-9]{2,8})+)*(-x(-[A-Za-z0-9]{1,8})+)?|x(-[A-Za-z0-9]{1,8})+|i-(ami|bnn|default|enochian|hak|klingon|lux|mingo|navajo|pwn|tao|tay|tsu)|en-GB-oed|sgn-(BE-FR|BE-NL|CH-DE))$", re.IGNORECASE)


class MetadataError(ValueError):
    """A description that can't be used."""


def is_language(tag: Any) -> bool:
    return isinstance(tag, str) and bool(_LANGUAGE.match(tag))


class MetadataParser:
    """Parses one document. resolver(url) gives the JSON of linked schemas and dialects."""

    def __init__(self, base: str, resolver: Callable[[str], Any] | None = None, language: str = "und"):
        self.base, self.resolver, self.language = base, resolver, language
        self.warnings: list[str] = []

    def warn(self, message: str) -> None:
        self.warnings.append(message)

    # --- roots

    def parse(self, document: str | dict) -> TableGroup:
        if isinstance(document, str):
            try:
                document = json.loads(document.lstrip("﻿"))
            except json.JSONDecodeError as e:
                raise MetadataError(f"not JSON: {e}") from e
        if not isinstance(document, dict):
            raise MetadataError("a description is a JSON object")
        self._context(document.get("@context"))
        if "tables" in document:
            group = self._group(document)
        elif "url" in document:
            table = self._table(document)
            group = TableGroup([table])
        else:
            raise MetadataError("a description has `tables` or `url`")
        group.language, group.warnings = self.language, self.warnings
        return group

    def _context(self, context: Any) -> None:
        if context is None or isinstance(context, str):
            return
        for part in context if isinstance(context, list) else [context]:
            if not isinstance(part, dict):
                continue
            for key, value in part.items():
                if key == "@base" and isinstance(value, str):
                    self.base = urljoin(self.base, value)
                elif key == "@language":
                    if is_language(value):
                        self.language = value
                    else:
                        self.warn(f"@language {value!r} isn't a language tag")
                else:
                    raise MetadataError(f"@context may hold @base and @language, not {key!r}")

    # --- property readers

    def _kind(self, obj: dict, kind: str) -> None:
        if "@type" in obj and obj["@type"] != kind:
            raise MetadataError(f"@type is {obj['@type']!r} where {kind!r} is described")
        if "@id" in obj and kind != "Datatype":
            self._link(obj["@id"], "@id")

    def _link(self, value: Any, what: str) -> str | None:
        if not isinstance(value, str):
            self.warn(f"{what} isn't a string")
            return None
        if value.startswith("_:"):
            raise MetadataError(f"{what} may not be a blank node")
        return expand_curie(value) or urljoin(self.base, value)

    def _bool(self, obj: dict, key: str, default: bool, fatal: bool = False) -> bool:
        value = obj.get(key, default)
        if isinstance(value, bool):
            return value
        if fatal:
            raise MetadataError(f"{key} is true or false")
        self.warn(f"{key} is true or false, not {value!r}")
        return default

    def _count(self, obj: dict, key: str, default: int | None) -> int | None:
        value = obj.get(key, default)
        if value is default or (isinstance(value, int) and not isinstance(value, bool) and value >= 0):
            return value
        self.warn(f"{key} is a number from 0 on, not {value!r}")
        return default

    def _array(self, obj: dict, key: str) -> list:
        value = obj.get(key, [])
        if isinstance(value, list):
            return value
        self.warn(f"{key} isn't an array")
        return []

    def _names(self, value: Any, what: str) -> tuple[str, ...]:
        values = value if isinstance(value, list) else [value]
        if not values or not all(isinstance(v, str) for v in values):
            self.warn(f"{what} names columns")
            return ()
        return tuple(values)

    def _natural(self, value: Any, what: str) -> dict[str, list[str]]:
        """Language maps: a string or an array stands for the document's language."""
        if isinstance(value, str):
            return {self.language: [value]}
        if isinstance(value, list):
            return {self.language: [v for v in value if isinstance(v, str)]}
        if isinstance(value, dict):
            out = {}
            for tag, texts in value.items():
                if not is_language(tag):
                    self.warn(f"{what}: {tag!r} isn't a language tag")
                    continue
                out[tag] = [v for v in (texts if isinstance(texts, list) else [texts]) if isinstance(v, str)]
            return out
        self.warn(f"{what} isn't text")
        return {}

    def _object(self, value: Any, what: str) -> dict | None:
        if isinstance(value, str):
            if self.resolver is None:
                raise MetadataError(f"{what} is a link, and there is no resolver")
            value = self.resolver(urljoin(self.base, value))
            if isinstance(value, dict):
                value = {k: v for k, v in value.items() if k != "@context"}
        if not isinstance(value, dict):
            self.warn(f"{what} isn't an object")
            return None
        return value

    def _common(self, obj: dict, kind: str) -> dict[str, Any]:
        """Properties with a prefix or an absolute name; the others are known for the kind, or warned of."""
        for key in obj:
            if ":" not in key and key not in INHERITED and key not in PROPERTIES[kind]:
                self.warn(f"{key!r} is no property of a {kind}")
        return {k: v for k, v in obj.items() if ":" in k}

    # --- parts

    def _group(self, obj: dict) -> TableGroup:
        self._kind(obj, "TableGroup")
        tables = obj["tables"]
        if not isinstance(tables, list) or not tables:
            raise MetadataError("`tables` is an array with at least one table")
        group = TableGroup(id=self._link(obj["@id"], "@id") if "@id" in obj else None)
        group.props = self._inherited(obj)
        if "dialect" in obj:
            group.dialect = self._dialect(self._object(obj["dialect"], "dialect"))
        shared = self._object(obj["tableSchema"], "tableSchema") if "tableSchema" in obj else None
        for t in tables:
            if not isinstance(t, dict):
                self.warn("a table isn't an object")
                continue
            group.tables.append(self._table({"tableSchema": shared} | t if shared else t))
        if not group.tables:
            raise MetadataError("no table is described")
        group.common, group.notes = self._common(obj, "TableGroup"), self._array(obj, "notes")
        return group

    def _table(self, obj: dict) -> Table:
        self._kind(obj, "Table")
        url = self._link(obj.get("url"), "url")
        if url is None:
            raise MetadataError("a table has a `url`")
        table = Table(url, id=self._link(obj["@id"], "@id") if "@id" in obj else None)
        table.suppress_output = self._bool(obj, "suppressOutput", False, fatal=True)
        table.props = self._inherited(obj)
        if "dialect" in obj:
            table.dialect = self._dialect(self._object(obj["dialect"], "dialect"))
        if "tableSchema" in obj and (schema := self._object(obj["tableSchema"], "tableSchema")) is not None:
            table.schema = self._schema(schema)
        if obj.get("tableDirection", "auto") not in ("rtl", "ltr", "auto"):
            self.warn("tableDirection is rtl, ltr or auto")
        table.common, table.notes = self._common(obj, "Table"), self._array(obj, "notes")
        return table

    def _schema(self, obj: dict) -> Schema:
        self._kind(obj, "Schema")
        schema = Schema(columns=[], props=self._inherited(obj), common=self._common(obj, "Schema"))
        schema.id = self._link(obj["@id"], "@id") if "@id" in obj else None
        virtual = False
        for k, c in enumerate(self._array(obj, "columns")):
            if not isinstance(c, dict):
                self.warn(f"column {k + 1} isn't an object")
                continue
            column = self._column(c, k + 1)
            if virtual and not column.virtual:
                raise MetadataError("virtual columns come last")
            virtual = column.virtual
            schema.columns.append(column)
        names = [c.name for c in schema.columns]
        if len(set(names)) < len(names):
            raise MetadataError("column names repeat")
        for key, attribute in (("primaryKey", "primary_key"), ("rowTitles", "row_titles")):
            if key in obj:
                found = self._names(obj[key], key)
                if any(n not in names for n in found):
                    self.warn(f"{key} names an unknown column")
                    found = ()
                setattr(schema, attribute, found)
        for fk in self._array(obj, "foreignKeys"):
            if key := self._foreign_key(fk, names):
                schema.foreign_keys.append(key)
        return schema

    def _foreign_key(self, obj: Any, names: list[str]) -> ForeignKey | None:
        ref = self._object(obj["reference"], "reference") if isinstance(obj, dict) and "reference" in obj else None
        if ref is None:
            self.warn("a foreign key has columns and a reference")
            return None
        columns = self._names(obj.get("columnReference"), "columnReference")
        targets = self._names(ref.get("columnReference"), "columnReference")
        resource = self._link(ref["resource"], "resource") if "resource" in ref else None
        schema = self._link(ref["schemaReference"], "schemaReference") if "schemaReference" in ref else None
        if not columns or len(columns) != len(targets) or (resource is None) == (schema is None):
            raise MetadataError("a foreign key refers to a resource or a schema, by as many columns as it has")
        if any(c not in names for c in columns):
            raise MetadataError("a foreign key names an unknown column")
        return ForeignKey(columns, resource, schema, targets)

    def _column(self, obj: dict, number: int) -> Column:
        self._kind(obj, "Column")
        titles = self._natural(obj["titles"], "titles") if "titles" in obj else {}
        name = obj.get("name")
        if name is not None and (not isinstance(name, str) or name.startswith("_") or not name):
            self.warn(f"{name!r} can't be a column name")
            name = None
        if name is None:
            first = next((t[0] for tag in (self.language, "und", *titles) if (t := titles.get(tag))), None)
            name = quote(first, safe="~") if first is not None else f"_col.{number}"
        column = Column(name, titles, self._bool(obj, "virtual", False), self._bool(obj, "suppressOutput", False, fatal=True), self._inherited(obj), self._common(obj, "Column"))
        return column

    def _inherited(self, obj: dict) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for key in LINKS:
            if key in obj:
                if isinstance(obj[key], str):
                    out[key] = obj[key]
                else:
                    self.warn(f"{key} isn't a template")
        if "datatype" in obj:
            out["datatype"] = self._datatype(obj["datatype"])
        if "lang" in obj:
            if is_language(obj["lang"]):
                out["lang"] = obj["lang"]
            else:
                self.warn(f"lang {obj['lang']!r} isn't a language tag")
        if "null" in obj:
            values = obj["null"] if isinstance(obj["null"], list) else [obj["null"]]
            if all(isinstance(v, str) for v in values):
                out["null"] = tuple(values)
            else:
                self.warn("null is text")
        for key in ("default", "separator"):
            if key in obj:
                if isinstance(obj[key], str) or (key == "separator" and obj[key] is None):
                    out[key] = obj[key]
                else:
                    self.warn(f"{key} is text")
        for key in ("ordered", "required"):
            if key in obj:
                out[key] = self._bool(obj, key, False)
        if "textDirection" in obj and obj["textDirection"] not in ("ltr", "rtl", "auto", "inherit"):
            self.warn("textDirection is ltr, rtl, auto or inherit")
        return out

    def _datatype(self, value: Any) -> Datatype:
        if isinstance(value, str):
            value = {"base": value}
        if not isinstance(value, dict):
            self.warn("datatype is a name or an object")
            return Datatype()
        base = value.get("base", "string")
        if base not in REGISTRY:
            self.warn(f"{base!r} isn't a datatype")
            base = "string"
        out = Datatype(base)
        if "@id" in value:
            out.id = self._link(value["@id"], "@id")
            if any(out.id == d.iri for d in REGISTRY.values()):
                raise MetadataError("@id of a datatype may not be that of a built-in one")
        kind = REGISTRY[base].kind
        if "format" in value:
            out.format = self._format(value["format"], kind)
        limits = {k: value[k] for k in LIMITS if k in value}
        lengths = {k: value[k] for k in LENGTHS if k in value}
        if limits and kind not in ("numeric", "date", "time", "dateTime", "duration"):
            raise MetadataError(f"{base} has no order, so no {next(iter(limits))}")
        if lengths and (kind not in ("text", "binary") or any(not isinstance(v, int) or v < 0 for v in lengths.values())):
            raise MetadataError(f"{base} has no such length")
        for a, b in (("minimum", "minInclusive"), ("maximum", "maxInclusive")):
            if a in limits:
                limits.setdefault(b, limits.pop(a))
        if {"minInclusive", "minExclusive"} <= set(limits) or {"maxInclusive", "maxExclusive"} <= set(limits):
            raise MetadataError("a limit is inclusive or exclusive, not both")
        n, low, high = lengths.get("length"), lengths.get("minLength"), lengths.get("maxLength")
        if (n is not None and ((low is not None and n < low) or (high is not None and n > high))) or (low is not None and high is not None and low > high):
            raise MetadataError("lengths contradict each other")
        out.constraints = limits | lengths
        return out

    def _format(self, value: Any, kind: str) -> str | NumericFormat | None:
        from ..functions.formats import FormatError, number_regex

        if kind == "numeric":
            parts = value if isinstance(value, dict) else {"pattern": value}
            fmt = NumericFormat(parts.get("pattern"), (parts.get("decimalChar") or ".")[0], (parts.get("groupChar") or ",")[0])
            try:
                number_regex(fmt)
            except FormatError as e:
                self.warn(str(e))
                return None
            return fmt
        if not isinstance(value, str):
            self.warn("format is text")
            return None
        if kind == "boolean" and len(value.split("|")) != 2:
            self.warn(f"{value!r} isn't a boolean format")
            return None
        if kind in ("text", "duration", "binary"):
            try:
                re.compile(value)
            except re.error:
                self.warn(f"{value!r} isn't a regular expression")
                return None
        if kind in ("date", "time", "dateTime") and not re.fullmatch(r"[yuMdHhmsSTXxZa'/.:\- ]+", value):
            self.warn(f"{value!r} isn't a pattern of dates or times")
            return None
        return value

    def _dialect(self, obj: dict | None) -> Dialect | None:
        if obj is None:
            return None
        self._kind(obj, "Dialect")
        d = Dialect()
        for key, attribute, nullable in (("commentPrefix", "comment_prefix", True), ("delimiter", "delimiter", False), ("encoding", "encoding", False), ("quoteChar", "quote_char", True)):
            if key in obj:
                if (isinstance(obj[key], str) and obj[key]) or (nullable and obj[key] is None):
                    setattr(d, attribute, obj[key])
                else:
                    self.warn(f"{key} is text")
        try:
            "".encode(d.encoding)
        except LookupError:
            self.warn(f"{d.encoding!r} isn't an encoding")
            d.encoding = "utf-8"
        for key, attribute in (("doubleQuote", "double_quote"), ("header", "header"), ("skipBlankRows", "skip_blank_rows"), ("skipInitialSpace", "skip_initial_space")):
            setattr(d, attribute, self._bool(obj, key, getattr(d, attribute)))
        for key, attribute in (("skipColumns", "skip_columns"), ("skipRows", "skip_rows"), ("headerRowCount", "header_row_count")):
            setattr(d, attribute, self._count(obj, key, getattr(d, attribute)))
        if "lineTerminators" in obj:
            ends = obj["lineTerminators"] if isinstance(obj["lineTerminators"], list) else [obj["lineTerminators"]]
            d.line_terminators = tuple(e for e in ends if isinstance(e, str)) or d.line_terminators
        trim = obj.get("trim", "start" if d.skip_initial_space else "false")
        trim = {True: "true", False: "false"}.get(trim, trim) if isinstance(trim, bool) else trim
        if trim in ("true", "false", "start", "end"):
            d.trim = trim
        else:
            self.warn("trim is true, false, start or end")
        return d


def parse_metadata(document: str | dict, base: str, resolver: Callable[[str], Any] | None = None, language: str = "und") -> TableGroup:
    return MetadataParser(base, resolver, language).parse(document)


def check_header(table: Table, header: list[str], language: str = "und") -> list[str]:
    """What is wrong between a description's columns and a file's header: their number, or titles that differ."""
    columns = [c for c in table.schema.columns or [] if not c.virtual]
    if not columns:
        return []
    if len(columns) != len(header):
        return [f"{len(columns)} columns are described, the header has {len(header)}"]
    out = []
    for k, (c, h) in enumerate(zip(columns, header, strict=True)):
        titles = {t for texts in c.titles.values() for t in texts}
        if titles and h not in titles and quote(h, safe="~") != c.name:
            out.append(f"column {k + 1} is titled {h!r}, described as {sorted(titles)}")
    return out


__all__ = ["ABSOLUTE", "TYPES", "MetadataError", "MetadataParser", "check_header", "is_language", "parse_metadata"]
