"""From a raw cell to its value: white space, default, list, null. All are column expressions."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import Datatype
from .datatypes import COLLAPSE, KEEP, REGISTRY


def squeeze(x: Column, base: str) -> Column:
    """Line ends and tabs become spaces, then runs collapse and ends are trimmed, as far as the base asks for it."""
    kind = REGISTRY[base].white_space
    if kind == KEEP:
        return x
    spaced = F.translate(x, "\r\n\t", "   ")
    if kind != COLLAPSE:
        return spaced
    # Most cells have no white space but single spaces: those only need a trim.
    rare = reduce(lambda a, b: a | b, [x.contains(c) for c in ("  ", "\t", "\n", "\v", "\f", "\r")])
    return F.when(rare, F.regexp_replace(F.trim(spaced), r"\s+", " ")).otherwise(F.trim(x))


def is_null(x: Column, nulls: tuple[str, ...]) -> Column:
    return x.isin(*nulls) if nulls else F.lit(False)


def or_default(x: Column, default: str | None) -> Column:
    return F.when(x == "", F.lit(default)).otherwise(x)


def scalar_value(raw: Column, props: dict[str, Any], bare: bool = False) -> Column:
    """The text of a cell, or null. bare: the text of a number or date, which has no white space."""
    datatype: Datatype = props["datatype"]
    x = raw if bare else squeeze(raw, datatype.base)
    if props["default"]:
        x = or_default(x, props["default"])
    for null in props["null"]:
        x = F.nullif(x, F.lit(null))
    return x


def list_value(raw: Column, props: dict[str, Any]) -> Column:
    """The texts of a cell with a separator: null if the whole cell is, null elements where an element is."""
    datatype: Datatype = props["datatype"]
    x = or_default(squeeze(raw, datatype.base), props["default"])
    trims = datatype.base not in ("string", "anyAtomicType")

    def element(e: Column) -> Column:
        e = or_default(F.trim(e) if trims else e, props["default"])
        return F.when(~is_null(e, props["null"]), e)

    parts = F.transform(F.split(x, re.escape(props["separator"]), -1), element)
    return F.when(x.isNotNull() & ~is_null(x, props["null"]), parts)
