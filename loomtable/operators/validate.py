"""What is wrong with a table, as a frame (table, row, column, kind, value)."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import squeeze
from ..functions.datatypes import REGISTRY
from ..functions.formats import Formatted, compile_format
from ..functions.template import expressions
from ..plans import model
from .triples import CompiledColumn, TableCompiler

SCHEMA = "table string, row string, column string, kind string, value string"


def _decimal_order(x: Column, limit: str) -> Column:
    """-1, 0 or 1 as the decimal text x is below, at or above the limit, of any number of digits.

    Doubles settle all but what rounds to the limit's double; there digits are compared.
    """
    sign, whole, part = _digits(limit)
    near = x.try_cast("double")
    point = F.lit(float(limit))
    bare = F.regexp_replace(x, r"^[+-]", "")
    digits = F.ltrim(F.substring_index(bare, ".", 1), F.lit("0"))
    rest = F.when(bare.contains("."), F.rtrim(F.substring_index(bare, ".", -1), F.lit("0"))).otherwise(F.lit(""))
    size = F.when(F.length(digits) != len(whole), F.sign(F.length(digits) - len(whole)).cast("int"))
    for a, b in ((digits, whole), (rest, part)):
        step = F.when(a < b, F.lit(-1)).when(a > b, F.lit(1))
        size = F.coalesce(size, step)
    size = F.coalesce(size, F.lit(0)) * (-1 if sign < 0 else 1)
    nothing = (digits == "") & (rest == "")
    exact = F.when(nothing, F.lit(-sign)).when(F.lit(sign == 0), F.when(x.startswith("-"), F.lit(-1)).otherwise(F.lit(1))).when(x.startswith("-") != F.lit(sign < 0), F.lit(-sign)).otherwise(size)
    return F.when(near < point, F.lit(-1)).when(near > point, F.lit(1)).otherwise(exact)


def _digits(text: str) -> tuple[int, str, str]:
    """Sign, and digits before and after the point, of a decimal on the driver."""
    number = Decimal(text)
    plain = format(abs(number), "f")
    whole, _, part = plain.partition(".")
    return (number > 0) - (number < 0), whole.lstrip("0"), part.rstrip("0")


#: Seconds of a day, and of the shortest and longest months.
DAY, SHORT, LONG = 86_400, 28 * 86_400, 31 * 86_400
_DURATION = r"^(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def _duration_order(x: Column, limit: str) -> Column:
    """-1 or 1 where a duration is below or above the limit whatever months it starts in, else 0."""
    m = re.match(_DURATION, limit)
    if not m:
        raise ValueError(f"{limit!r} isn't a duration")
    number = lambda k: F.coalesce(F.regexp_extract(x, _DURATION, k).try_cast("double"), F.lit(0.0))
    sign = F.when(x.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    own = [float(m[k] or 0) * (-1 if m[1] else 1) for k in range(2, 8)]
    months = sign * (number(2) * 12 + number(3)) - (own[0] * 12 + own[1])
    seconds = sign * (number(4) * DAY + number(5) * 3600 + number(6) * 60 + number(7)) - (own[2] * DAY + own[3] * 3600 + own[4] * 60 + own[5])
    low, high = F.least(months * SHORT, months * LONG) + seconds, F.greatest(months * SHORT, months * LONG) + seconds
    return F.when(high < 0, F.lit(-1)).when(low > 0, F.lit(1)).otherwise(F.lit(0))


def _order(x: Column, limit: Any, datatype: model.Datatype) -> Column:
    """-1, 0 or 1 as x is below, at or above the limit in the order of its datatype; null where it can't be read."""
    info, limit = REGISTRY[datatype.base], str(limit)
    if info.kind == "duration":
        return _duration_order(x, limit)
    if info.kind == "numeric" and info.spark not in ("double", "float"):
        return _decimal_order(x, limit)
    kind = "double" if info.kind == "numeric" else "timestamp" if info.kind in ("date", "dateTime") else "string"
    a, b = x.try_cast(kind), F.lit(limit).try_cast(kind)
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).when(a == b, F.lit(0))


def _length(x: Column, datatype: model.Datatype) -> Column:
    if REGISTRY[datatype.base].kind == "binary":
        return F.length(F.try_to_binary(x, F.lit("hex" if datatype.base == "hexBinary" else "base64")))
    return F.char_length(x)


#: A constraint: (text as written, canonical text where the format admits it, limit, datatype) -> what breaks it.
Constraint = Callable[[Column, Column, Any, model.Datatype], Column]
CONSTRAINTS: dict[str, Constraint] = {
    "minInclusive": lambda x, t, limit, d: _order(t, limit, d) < 0,
    "minExclusive": lambda x, t, limit, d: _order(t, limit, d) <= 0,
    "maxInclusive": lambda x, t, limit, d: _order(t, limit, d) > 0,
    "maxExclusive": lambda x, t, limit, d: _order(t, limit, d) >= 0,
    "length": lambda x, t, limit, d: _length(x, d) != limit,
    "minLength": lambda x, t, limit, d: _length(x, d) < limit,
    "maxLength": lambda x, t, limit, d: _length(x, d) > limit,
}


def register_constraint(name: str, breaks: Constraint) -> None:
    """Adds or replaces a constraint; datatypes name it among their constraints."""
    CONSTRAINTS[name] = breaks


def element_faults(x: Column, told: Formatted, datatype: model.Datatype) -> list[tuple[str, Column]]:
    """(kind, predicate) of everything that can be wrong with one value that isn't null."""
    out = [("format" if datatype.format is not None else "datatype", ~told.valid)]
    return out + [(key, breaks(x, told.value, datatype.constraints[key], datatype)) for key, breaks in CONSTRAINTS.items() if key in datatype.constraints]


def _fault(kind: str, wrong: Column, column: str, value: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(column).alias("column"), F.lit(kind).alias("kind"), value.cast("string").alias("value")))


def column_faults(compiler: TableCompiler, c: CompiledColumn) -> list[Column]:
    name, datatype = c.column.name, c.props["datatype"]
    if c.column.virtual:
        return []
    present = c.values if c.values is not None else c.value
    out = [_fault("required", present.isNull(), name, squeeze(compiler.raw[name], datatype.base))] if c.props["required"] else []
    if c.values is not None:

        def read(v: Column) -> Column:
            told = compile_format(v, datatype)
            return F.struct(v.alias("x"), told.valid.alias("valid"), told.text.alias("text"))

        some = F.transform(F.filter(c.values, lambda v: v.isNotNull()), read)
        faults = lambda e: element_faults(e["x"], Formatted(e["valid"], e["text"]), datatype)
        told = F.transform(some, lambda e: F.struct(e["x"].alias("x"), F.array(*[F.coalesce(wrong, F.lit(False)) for _, wrong in faults(e)]).alias("wrong")))
        kinds = [kind for kind, _ in element_faults(F.lit(""), Formatted(F.lit(True), F.lit("")), datatype)]
        for k, kind in enumerate(kinds):
            bad = F.transform(F.filter(told, lambda e, k=k: e["wrong"][k]), lambda e: e["x"])
            out.append(_fault(kind, F.size(bad) > 0, name, F.array_join(bad, "|")))
        return out
    return out + [_fault(kind, c.value.isNotNull() & wrong, name, c.value) for kind, wrong in element_faults(c.value, compiler.told(c.column, c.props), datatype)]


def unbound_faults(compiler: TableCompiler, c: CompiledColumn) -> list[Column]:
    """Values that give no triple, as a variable of the subject's or predicate's template has none."""
    if c.column.virtual or c.column.suppress_output or compiler.table.suppress_output:
        return []
    present = c.values if c.values is not None else c.value
    shown = c.value if c.values is None else F.array_join(c.values, "|")
    nodes = {"aboutUrl": c.subject.value, "propertyUrl": c.predicate}
    return [_fault(kind, present.isNotNull() & node.isNull(), c.column.name, shown) for kind, node in nodes.items() if c.props[kind] and expressions(c.props[kind])]


def cell_errors(compiler: TableCompiler, row: Column) -> DataFrame:
    """Errors of single cells: one pass over the table, no shuffle. row: what names a row in the result."""
    faults = [f for c in compiler.compiled for f in column_faults(compiler, c) + unbound_faults(compiler, c)]
    if not faults:
        return compiler.frame.sparkSession.createDataFrame([], SCHEMA)
    found = F.explode(F.filter(F.array(*faults), lambda f: f.isNotNull()))
    return compiler.staged.select(F.lit(compiler.table.url).alias("table"), row.cast("string").alias("row"), found.alias("f")).select("table", "row", "f.*")


def _key(compiler: TableCompiler, names: tuple[str, ...]) -> list[Column]:
    by = {c.column.name: c for c in compiler.compiled}
    return [by[n].value.alias(f"k{i}") for i, n in enumerate(names)]


def primary_key_errors(compiler: TableCompiler) -> DataFrame:
    """Keys that several rows have, or that have a null part; counted by key, combined before the shuffle."""
    names = compiler.table.schema.primary_key
    keys = [f"k{i}" for i in range(len(names))]
    counts = compiler.staged.select(*_key(compiler, names)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    wrong = counts.filter((F.col("n") > 1) | missing)
    shown = F.concat_ws("|", *[F.coalesce(k, F.lit("")) for k in keys])
    return wrong.select(F.lit(compiler.table.url).alias("table"), F.lit(None).cast("string").alias("row"), F.lit("|".join(names)).alias("column"), F.lit("primaryKey").alias("kind"), shown.alias("value"))


def foreign_key_errors(compiler: TableCompiler, parent: TableCompiler, key: model.ForeignKey, row: Column) -> DataFrame:
    """Rows whose key isn't null in any part and that no row of the parent has: an anti join, broadcast only if Spark finds the parent small."""
    keys = [f"k{i}" for i in range(len(key.columns))]
    child = compiler.staged.select(row.cast("string").alias("row"), *_key(compiler, key.columns)).dropna(subset=keys)
    wanted = parent.staged.select(*_key(parent, key.references)).dropna(subset=keys)
    shown = F.concat_ws("|", *keys)
    return child.join(wanted, keys, "left_anti").select(F.lit(compiler.table.url).alias("table"), "row", F.lit("|".join(key.columns)).alias("column"), F.lit("foreignKey").alias("kind"), shown.alias("value"))


def validate_group(compilers: list[TableCompiler]) -> DataFrame:
    """All errors of a group's tables; rows are named by `_row`."""
    frames: list[DataFrame] = []
    for c in compilers:
        row = F.col("_row") if "_row" in c.frame.columns else F.lit(None)
        frames.append(cell_errors(c, row))
        if c.table.schema.primary_key:
            frames.append(primary_key_errors(c))
        for key in c.table.schema.foreign_keys:
            parent = next((p for p in compilers if p.table.url == key.resource or (key.schema_reference and p.table.schema.id == key.schema_reference)), None)
            if parent is None:
                raise ValueError(f"a foreign key refers to {key.resource or key.schema_reference}, which the group lacks")
            frames.append(foreign_key_errors(c, parent, key, row))
    return reduce(lambda a, b: a.unionByName(b), frames)
