"""Registry of datatypes: IRI, white-space class and Spark type; new ones can be registered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.context import CSVW, RDF, XSD

#: White space is kept (KEEP), line ends and tabs become spaces (REPLACE), or runs collapse too (COLLAPSE).
KEEP, REPLACE, COLLAPSE = "keep", "replace", "collapse"


@dataclass(frozen=True)
class DatatypeInfo:
    name: str
    iri: str
    white_space: str
    spark: str
    #: numeric, boolean, date, time, dateTime, duration, binary or text
    kind: str
    low: int | None = None
    high: int | None = None


REGISTRY: dict[str, DatatypeInfo] = {}


def register(name: str, iri: str, white_space: str = COLLAPSE, spark: str = "string", kind: str = "text", low: int | None = None, high: int | None = None) -> DatatypeInfo:
    """Adds or replaces a datatype."""
    REGISTRY[name] = DatatypeInfo(name, iri, white_space, spark, kind, low, high)
    return REGISTRY[name]


def _fill() -> None:
    for name in ("token", "language", "Name", "NMTOKEN", "QName", "anyURI", "gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth"):
        register(name, XSD + name)
    register("string", XSD + "string", KEEP)
    register("normalizedString", XSD + "normalizedString", REPLACE)
    register("any", XSD + "anyAtomicType")
    register("anyAtomicType", XSD + "anyAtomicType", KEEP)
    register("langString", RDF + "langString")
    register("xml", RDF + "XMLLiteral")
    register("html", RDF + "HTML", KEEP)
    register("json", CSVW + "JSON", KEEP)
    register("boolean", XSD + "boolean", spark="boolean", kind="boolean")
    for name in ("number", "double"):
        register(name, XSD + "double", spark="double", kind="numeric")
    register("float", XSD + "float", spark="float", kind="numeric")
    register("decimal", XSD + "decimal", spark="decimal(38,10)", kind="numeric")
    for name, low, high in (("integer", None, None), ("nonNegativeInteger", 0, None), ("positiveInteger", 1, None), ("nonPositiveInteger", None, 0), ("negativeInteger", None, -1)):
        register(name, XSD + name, spark="decimal(38,0)", kind="numeric", low=low, high=high)
    for name, spark, bits in (("long", "bigint", 63), ("int", "int", 31), ("short", "smallint", 15), ("byte", "tinyint", 7)):
        register(name, XSD + name, spark=spark, kind="numeric", low=-(1 << bits), high=(1 << bits) - 1)
    for name, spark, bits in (("unsignedLong", "decimal(20,0)", 64), ("unsignedInt", "bigint", 32), ("unsignedShort", "int", 16), ("unsignedByte", "smallint", 8)):
        register(name, XSD + name, spark=spark, kind="numeric", low=0, high=(1 << bits) - 1)
    register("date", XSD + "date", spark="date", kind="date")
    for name in ("dateTime", "datetime"):
        register(name, XSD + "dateTime", spark="timestamp", kind="dateTime")
    register("dateTimeStamp", XSD + "dateTimeStamp", spark="timestamp", kind="dateTime")
    register("time", XSD + "time", kind="time")
    for name in ("duration", "dayTimeDuration", "yearMonthDuration"):
        register(name, XSD + name, kind="duration")
    for name, iri in (("binary", "base64Binary"), ("base64Binary", "base64Binary"), ("hexBinary", "hexBinary")):
        register(name, XSD + iri, spark="binary", kind="binary")


_fill()

#: Integers have no fraction and no exponent.
INTEGERS = frozenset(n for n, d in REGISTRY.items() if d.kind == "numeric" and n not in ("number", "double", "float", "decimal"))

_DURATION = {
    "duration": r"^-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$",
    "dayTimeDuration": r"^-?P(?=.)(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$",
    "yearMonthDuration": r"^-?P(?=.)(\d+Y)?(\d+M)?$",
}
_ZONE = r"(Z|[+-]\d{2}:\d{2})?"
_LEXICAL = {"gDay": rf"^---\d{{2}}{_ZONE}$", "gMonth": rf"^--\d{{2}}{_ZONE}$", "gMonthDay": rf"^--\d{{2}}-\d{{2}}{_ZONE}$", "gYear": rf"^-?\d{{4,}}{_ZONE}$", "gYearMonth": rf"^-?\d{{4,}}-\d{{2}}{_ZONE}$", "language": r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$", "NMTOKEN": r"^[\w.:\-]+$", "Name": r"^[A-Za-z_:][\w.:\-]*$"}


def lexically_valid(base: str, x: Column) -> Column:
    """Whether text is in the lexical space of a datatype without a format."""
    info = REGISTRY[base]
    if info.kind == "boolean":
        return x.isin("true", "false", "1", "0")
    if info.kind == "numeric":
        if base in INTEGERS:
            ok = x.rlike(r"^[+-]?\d+$")
            number = x.try_cast("decimal(38,0)")
            if info.low is not None:
                ok = ok & (number >= F.lit(info.low).cast("decimal(38,0)"))
            if info.high is not None:
                ok = ok & (number <= F.lit(info.high).cast("decimal(38,0)"))
            return F.coalesce(ok, F.lit(False))
        if base == "decimal":
            return x.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
        return x.rlike(r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN)$")
    if info.kind == "date":
        return x.rlike(rf"^-?\d{{4,}}-\d{{2}}-\d{{2}}{_ZONE}$") & x.substr(1, 10).try_cast("date").isNotNull()
    if info.kind == "dateTime":
        zone = _ZONE if base != "dateTimeStamp" else _ZONE[:-1]
        return x.rlike(rf"^-?\d{{4,}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?{zone}$") & x.substr(1, 19).try_cast("timestamp_ntz").isNotNull()
    if info.kind == "time":
        return x.rlike(rf"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?{_ZONE}$")
    if info.kind == "duration":
        return x.rlike(_DURATION[base])
    if info.kind == "binary":
        hexes = base == "hexBinary"
        return x.rlike(r"^([0-9A-Fa-f]{2})*$") if hexes else F.try_to_binary(x, F.lit("base64")).isNotNull()
    return x.rlike(_LEXICAL[base]) if base in _LEXICAL else F.lit(True)
