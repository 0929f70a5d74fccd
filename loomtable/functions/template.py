"""URI templates compiled to column expressions; an unbound variable makes the whole template null."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote, urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.context import ABSOLUTE, expand_curie

_EXPRESSION = re.compile(r"\{([^{}]+)\}")


def percent_encoded(x: Column) -> Column:
    """Everything but unreserved characters as UTF-8 octets in percent form."""
    x = F.url_encode(x)
    for code, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def iri_safe(x: Column) -> Column:
    """Reserved characters stay; what no IRI may hold is put in percent form."""
    for c in ' "<>\\^`{|}':
        x = F.replace(x, F.lit(c), F.lit(quote(c)))
    return x


def expressions(template: str) -> list[str]:
    return [v for e in _EXPRESSION.findall(template) for v in e.lstrip("#+").split(",")]


def encoded(value: Column, form: str) -> Column:
    """A variable's text as a template's form ("", "+" or "#") writes it; an empty one is unbound."""
    value = F.nullif(value, F.lit(""))
    return iri_safe(value) if form else percent_encoded(value)


def compile_template(template: str, lookup: Callable[[str, str], Column], base: str) -> Column:
    """The IRI of a row. Forms: {a}, {a,b}, {+a}, {#a}. lookup gives a variable's text, encoded for the form (null: unbound).

    Compact IRIs are expanded; relative ones are resolved against base, on the driver where the
    template's beginning settles it.
    """
    template = (expand_curie(template.split("{")[0]) or template.split("{")[0]) + template[len(template.split("{")[0]) :]
    parts: list[Column] = []
    at = 0
    for m in _EXPRESSION.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        body = m[1]
        form = body[0] if body[0] in "#+" else ""
        names = body[len(form) :].split(",")
        values = [lookup(n, form) for n in names]
        if form == "#":
            parts.append(F.lit("#"))
        for k, v in enumerate(values):
            parts += [F.lit(","), v] if k else [v]
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    if not parts:
        return F.lit(base)
    head = template.split("{")[0]
    filled = F.concat(*parts) if len(parts) > 1 else parts[0]
    if ABSOLUTE.match(head):
        return filled
    if "{" not in template:
        return F.lit(urljoin(base, template) if template else base)
    if head.startswith("#") or template.startswith("{#"):
        return F.concat(F.lit(base.split("#")[0]), filled)
    if head:  # resolve the literal beginning; a last segment that goes on is kept whole
        marker = urljoin(base, head + "x")
        return F.concat(F.lit(marker[:-1]), *parts[1:])
    folder = urljoin(base, ".")
    return F.when(filled.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), filled).otherwise(F.concat(F.lit(folder), filled))
