"""Finding and fetching descriptions and tables: resolvers, side files, `.well-known` templates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol
from urllib.parse import urljoin, urlparse

from pyspark.sql import SparkSession

from ..plans.metadata import MetadataError
from ..plans.model import Table, TableGroup


class Resolver(Protocol):
    """Maps the URLs of descriptions to what Spark reads."""

    def path(self, url: str) -> str:
        """Where Spark finds a table."""

    def text(self, url: str) -> str | None:
        """A small document, or None if there is none."""


class SparkResolver:
    """URLs are paths that Spark reads, after the longest matching prefix has been replaced."""

    def __init__(self, spark: SparkSession, mounts: dict[str, str] | None = None):
        self.spark, self.mounts = spark, mounts or {}

    def path(self, url: str) -> str:
        for prefix in sorted(self.mounts, key=len, reverse=True):
            if url.startswith(prefix):
                return self.mounts[prefix] + url[len(prefix) :]
        return url

    def text(self, url: str) -> str | None:
        jvm, path = self.spark._jvm, self.path(url)
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(place) or not fs.getFileStatus(place).isFile():
            return None
        rows = self.spark.read.option("wholetext", "true").text(path).collect()  # one small document
        return rows[0]["value"] if rows else ""


class MemoryResolver:
    """Documents by URL, for tests and programs that hold them; tables still come from Spark."""

    def __init__(self, documents: dict[str, str], paths: dict[str, str] | None = None):
        self.documents, self.paths = documents, paths or {}

    def path(self, url: str) -> str:
        return self.paths.get(url, url)

    def text(self, url: str) -> str | None:
        return self.documents.get(url)


def json_loader(resolver: Resolver) -> Callable[[str], Any]:
    def load(url: str) -> Any:
        text = resolver.text(url)
        if text is None:
            raise MetadataError(f"{url} isn't there")
        return json.loads(text.lstrip("﻿"))

    return load


def expand_location(template: str, url: str) -> str:
    """A location template: {url} and {+url} stand for the table's URL."""
    return urljoin(url, template.replace("{+url}", url).replace("{url}", url))


def candidates(resolver: Resolver, url: str, link: str | None = None) -> Iterator[str]:
    """Where a table's description may be, in order: a link given with it, the site's templates, side files.

    The site's templates, if it has any, replace the two usual side files.
    """
    url = url.split("#")[0]
    if link:
        yield urljoin(url, link)
    parts = urlparse(url)
    templates = None
    if parts.scheme in ("http", "https", "file", "") or parts.netloc:
        templates = resolver.text(urljoin(url, "/.well-known/csvm"))
    names = [t.strip() for t in (templates or "").splitlines() if t.strip()] or ["{+url}-metadata.json", "csv-metadata.json"]
    for t in names:
        yield expand_location(t, url)


def locate(resolver: Resolver, url: str, link: str | None = None) -> tuple[str, str] | None:
    """The first candidate that is there and describes the table: (its URL, its text)."""
    for place in candidates(resolver, url, link):
        text = resolver.text(place)
        if text is not None and describes(text, place, url):
            return place, text
    return None


def describes(text: str, place: str, url: str) -> bool:
    """Whether a document names the table among its own."""
    try:
        doc = json.loads(text.lstrip("﻿"))
    except json.JSONDecodeError:
        return True  # a broken description is an error later, not a missing one
    tables = doc.get("tables", [doc]) if isinstance(doc, dict) else []
    return any(isinstance(t, dict) and urljoin(place, str(t.get("url", ""))) == url for t in tables if isinstance(tables, list))


def kind_of(source: str) -> str:
    """`json` or `csv`, by media type or by ending."""
    low = source.lower().split(";")[0].strip()
    if low in ("application/json", "application/csvm+json", "application/ld+json") or low.endswith((".json", ".jsonld")):
        return "json"
    return "csv"


def default_group(url: str) -> TableGroup:
    """A table of which nothing is known but its place."""
    return TableGroup([Table(url)])
