"""Formats of cells as column expressions: each gives whether text is valid and its canonical form (null if not)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import Datatype, NumericFormat
from .datatypes import INTEGERS, REGISTRY, lexically_valid


class FormatError(ValueError):
    """A format that the recommendation doesn't allow."""


@dataclass(frozen=True)
class Formatted:
    valid: Column
    text: Column

    @property
    def value(self) -> Column:
        return F.when(self.valid, self.text)


# --- boolean


def boolean_format(x: Column, pattern: str) -> Formatted:
    """`T|F`: exactly these two texts."""
    parts = pattern.split("|")
    if len(parts) != 2 or not all(parts):
        raise FormatError(f"a boolean format is two texts with a bar between them, not {pattern!r}")
    yes, no = x == parts[0], x == parts[1]
    return Formatted(yes | no, F.when(yes, F.lit("true")).when(no, F.lit("false")))


# --- numbers


def number_regex(fmt: NumericFormat) -> str:
    """An anchored regular expression of a number pattern: grouping, least and most digits, exponent, percent."""
    group, point = re.escape(fmt.group_char), re.escape(fmt.decimal_char)
    if fmt.pattern is None:
        whole = rf"(\d+({group}\d+)*)"
        return rf"^([+-]?({whole}({point}\d*)?|{point}\d+)([eE][+-]?\d+)?[%‰]?|NaN|-?INF)$"
    pattern = fmt.pattern
    allowed = set("0#E+-%‰.," + fmt.decimal_char + fmt.group_char)
    if not pattern or set(pattern) - allowed or not set(pattern) & set("0#"):
        raise FormatError(f"{pattern!r} isn't a number pattern")
    head = re.match(r"^[+\-%‰]*", pattern).group()
    tail = re.search(r"[%‰]*$", pattern[len(head) :]).group()
    body = pattern[len(head) : len(pattern) - len(tail)]
    body, _, exponent = body.partition("E")
    whole, _, part = body.partition(fmt.decimal_char)
    if fmt.decimal_char in part:
        raise FormatError(f"{pattern!r} has two decimal points")
    digits = whole.replace(fmt.group_char, "")
    if not re.fullmatch("#*0*", digits) or not re.fullmatch("0*#*", part.replace(fmt.group_char, "")):
        raise FormatError(f"the digits of {pattern!r} are out of order")
    least = digits.count("0")
    groups = whole.split(fmt.group_char)
    if len(groups) > 1:
        first, later = len(groups[-1]), len(groups[-2]) if len(groups) > 2 else len(groups[-1])
        if not first or not later:
            raise FormatError(f"{pattern!r} has an empty group")
        integer = rf"(\d{{1,{first}}}|\d{{1,{later}}}({group}\d{{{later}}})*{group}\d{{{first}}})"
        if least:
            integer = rf"(?=(?:{group}?\d){{{least}}}){integer}"
        if not least:
            integer = rf"{integer}?"
    else:
        integer = rf"\d{{{least},}}"
    fraction = ""
    if part:
        plain = part.replace(fmt.group_char, "")
        low, high = plain.count("0"), len(plain)
        pieces = part.split(fmt.group_char)
        if len(pieces) > 1:
            size = len(pieces[0])
            run = rf"(?=(?:\d{group}?){{{low},{high}}}(?:\D|$))(\d{{{size}}}{group})*\d{{1,{size}}}"
        else:
            run = rf"\d{{{max(1, low)},{high}}}"
        fraction = rf"{point}{run}" if low else rf"({point}{run})?"
    power = ""
    if exponent:
        signs = "[+-]?" if not exponent.startswith("+") else "[+-]"
        power = rf"E{signs}\d{{{exponent.count('0')},}}"
    sign = "[+-]" if head.startswith("+") else "[+-]?"
    return rf"^{sign}(?=.*\d){integer}{fraction}{power}{re.escape(tail)}$"


def number_format(x: Column, fmt: NumericFormat, base: str = "decimal") -> Formatted:
    """Digits stay as they are: grouping goes, the decimal character becomes a point, percents are divided."""
    valid = x.rlike(number_regex(fmt))
    plain = F.replace(x, F.lit(fmt.group_char), F.lit("")) if fmt.group_char else x
    if fmt.decimal_char != ".":
        plain = F.replace(plain, F.lit(fmt.decimal_char), F.lit("."))
    scaled = plain
    for mark, places in (("%", 2), ("‰", 3)):
        bare = F.regexp_replace(plain, f"{mark}$", "")
        shifted = (bare.try_cast("decimal(38,12)") / F.lit(10**places).cast("decimal(5,0)")).cast("string")
        shifted = F.regexp_replace(F.regexp_replace(shifted, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        scaled = F.when(plain.endswith(mark), shifted).otherwise(scaled)
    if base in INTEGERS:
        info = REGISTRY[base]
        number = scaled.try_cast("decimal(38,0)")
        valid = valid & scaled.rlike(r"^[+-]?\d+$")
        for limit, ok in ((info.low, lambda v: number >= v), (info.high, lambda v: number <= v)):
            if limit is not None:
                valid = valid & F.coalesce(ok(F.lit(limit).cast("decimal(38,0)")), F.lit(False))
    elif base == "decimal":
        valid = valid & ~scaled.rlike("[eE]|NaN|INF")
    return Formatted(valid, scaled)


# --- dates and times


def translate_pattern(pattern: str) -> str:
    """A pattern of the recommendation in Spark's letters: T is text, u is a year, fractions may be short, Z is an offset without colon."""
    out = re.sub(r"u+", "yyyy", pattern)
    out = re.sub(r"T", "'T'", out)
    out = re.sub(r"\.(S+)", r"[.\1]", out)
    return re.sub(r"Z+$", "XX", out)


#: How each kind is written, before the fraction.
ISO = {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "dateTime": "yyyy-MM-dd'T'HH:mm:ss"}


def temporal_format(x: Column, pattern: str, kind: str) -> Formatted:
    """Dates and times by a pattern. The local part is parsed by itself, so the offset of the source is kept.

    Trailing zeros of the fraction go; an offset is Z, whole hours, or hours and minutes.
    """
    whole = translate_pattern(pattern)
    valid = F.try_to_timestamp(x, F.lit(whole)).isNotNull()
    local, offset = x, F.lit("")
    if re.search(r"[XxZ]+$", pattern):
        whole = translate_pattern(re.sub(r"[XxZ]+$", "", pattern))
        local = F.regexp_replace(x, r"(Z|[+-]\d{2}(:?\d{2})?)$", "")
        mark = F.regexp_extract(x, r"(Z|[+-]\d{2}(:?\d{2})?)$", 1)
        minutes = F.right(mark, F.lit(2))
        offset = F.when(mark.rlike(r"^(Z|[+-]00(:?00)?)$"), F.lit("Z")).when((F.length(mark) == 3) | (minutes == "00"), F.substring(mark, 1, 3)).otherwise(F.concat(F.substring(mark, 1, 3), F.lit(":"), minutes))
    at = F.try_to_timestamp(local, F.lit(whole))
    text = F.date_format(at, ISO[kind])
    if kind != "date":
        text = F.concat(text, F.regexp_replace(F.date_format(at, ".SSSSSS"), r"\.?0+$", ""))
    return Formatted(valid & at.isNotNull(), F.concat(text, offset))


def default_temporal(x: Column, kind: str) -> Formatted:
    """Dates and date-times without a format: canonical text stays, other readable forms are written canonically in UTC."""
    canonical = lexically_valid(kind, x)
    # Text with a zone is an instant, shown in UTC; text without one is read as it stands, whatever the session's zone.
    seconds = F.unix_seconds(x.try_cast("timestamp")).try_cast("decimal(18,6)")
    zoned = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    written = F.when(x.rlike(r"\d:.*(Z|[A-Za-z]|[+-]\d{1,2}(:?\d{2})?)$"), zoned).otherwise(x.try_cast("timestamp_ntz")).cast("string")
    other = F.substring(written, 1, 10) if kind == "date" else F.replace(F.substring(written, 1, 19), F.lit(" "), F.lit("T"))
    return Formatted(canonical | other.isNotNull(), F.when(canonical, x).otherwise(other))


def _boolean(x: Column, d: Datatype) -> Formatted:
    return boolean_format(x, d.format)


def _number(x: Column, d: Datatype) -> Formatted:
    return number_format(x, d.format if isinstance(d.format, NumericFormat) else NumericFormat(pattern=d.format), d.base)


def _temporal(x: Column, d: Datatype) -> Formatted:
    return temporal_format(x, d.format, REGISTRY[d.base].kind)


def _expression(x: Column, d: Datatype) -> Formatted:
    return Formatted(x.rlike(f"^(?:{d.format})$"), x)


#: How a format is compiled, by kind of datatype; other kinds take a regular expression.
BUILDERS: dict[str, Callable[[Column, Datatype], Formatted]] = {"boolean": _boolean, "numeric": _number, "date": _temporal, "time": _temporal, "dateTime": _temporal}


def register_format(kind: str, builder: Callable[[Column, Datatype], Formatted]) -> None:
    """Compiles the formats of a kind of datatype with another builder."""
    BUILDERS[kind] = builder


def compile_format(x: Column, datatype: Datatype) -> Formatted:
    """Validity and canonical text of x under a datatype and its format."""
    info = REGISTRY[datatype.base]
    if datatype.format is not None:
        return BUILDERS.get(info.kind, _expression)(x, datatype)
    if datatype.base in ("date", "dateTime", "datetime"):
        return default_temporal(x, info.kind)
    return Formatted(lexically_valid(datatype.base, x), x)


def keeps_text(datatype: Datatype) -> bool:
    """Whether the canonical text is the text itself and nothing is checked when triples are made.

    Without a format only dates and date-times are read; validation checks the others.
    """
    return datatype.format is None and datatype.base not in ("date", "dateTime", "datetime")
