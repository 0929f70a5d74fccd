"""URL filter: prefix rules, and logistic regression on hashed character n-grams of host and path.

The longest rule whose host is the url's host or a domain above it, and whose path begins the url's
path, decides; elsewhere the model does. The model is trained on the driver from a small labelled
table of urls, and is a vector of fixed length (2 ** bits floats), which goes to the executors.

A null url, or one without "://", has an empty host and path and is judged like any other. Every row gives one row:
repeated rows and null page ids are kept, an empty table gives no rows, and no column but page_id and url is read, so
others may have any name. A long url is scored whole. Of rules of equal length the first by text decides; a score of
just the threshold blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
NGRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """rule: a host, a slash and a path prefix, as `example.com/en/`."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


#: Fixed values of the contract.
RULES = (UrlRule("com/", "allow"), UrlRule("example.com/en/", "block"), UrlRule("www.example.com/en/", "allow"), UrlRule("net/es/", "block"), UrlRule("net/fr/", "block"))


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table (1: block): hosts by kind, crossed with prefixes, endings and paths.

    No host name is taken from a table that is judged. The frame around the names (the example domains, sub-domains and
    kinds of path) is the one that urls of `pages` have.
    """
    bad = "casino-bonus casino-royal free-money free-spins best-bets adult-cams warez-crack replica-watches payday-loans cheap-meds quick-pills click-bait miracle-diet lottery-winner hot-singles bonus-poker fake-diplomas"
    good = "library cityhall weather gardening university newsroom history museum recipes chess theatre thermos thinker northern shelter mother wither station nation question mention letters others rather england reading singing ringing ocean river mountain harbour bakery cycling painting planet orchard village council kitchen rainfall traveller notebook bluebird cotton pepper lantern"
    hosts = [(h, 1) for h in bad.split()] + [(h, 0) for h in good.split()]
    tops, sub, paths = ("example.com", "example.net", "example.org"), ("", "www.", "blog.", "m."), ("/en/12", "/de/341?page=2&ref=x", "/fr/77.html", "/es/905/", "/en/5#top", "/en/68?utm_source=feed")
    return [(f"https://{s}{h}.{t}{p}", y) for (i, (h, y)), (j, t), (m, s), (k, p) in product(enumerate(hosts), enumerate(tops), enumerate(sub), enumerate(paths)) if (i + j + m + k) % 6 == 0]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?", "#" or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The rule (text) that decides, or null; rules are tried from the longest on, ties by text."""
    chain: Column | None = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chain = F.when(fits, F.lit(r.rule)) if chain is None else chain.when(fits, F.lit(r.rule))
    return chain if chain is not None else F.lit(None).cast("string")


def hashed_ngrams(host: str, path: str, bits: int = BITS, sizes: tuple[int, ...] = NGRAMS) -> np.ndarray:
    """Indexes of the n-grams of `^host/path`; digits count as one character."""
    out = []
    for salt, part in ((1, f"^{host}$"), (2, f"{path}$")):
        raw = np.frombuffer(part.encode(), np.uint8).astype(np.uint64)
        raw = np.where((raw >= 48) & (raw < 58), np.uint64(48), raw)
        for n in sizes:
            if len(raw) >= n:
                h = np.full(len(raw) - n + 1, salt * 1_000_003 + n, np.uint64)
                for k in range(n):
                    h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint64(0x100000001B3)
                out.append((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, host: str, path: str) -> float:
        f = hashed_ngrams(host, path, self.bits)
        z = self.bias + self.weights[f].sum() / np.sqrt(max(1, len(f)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[str, int]], bits: int = BITS, rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> UrlModel:
    """Logistic regression by stochastic gradient steps in a fixed order."""
    parts = []
    for url, y in rows:
        rest = url.partition("://")[2]
        host = rest[: min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])]
        path = rest[len(host) :]
        path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
        parts.append((hashed_ngrams(host.lower(), path, bits), y))
    w, b = np.zeros(1 << bits), 0.0
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(parts)):
            f, y = parts[i]
            n = np.sqrt(max(1, len(f)))
            g = 1 / (1 + np.exp(-np.clip(b + w[f].sum() / n, -30, 30))) - y
            w[f] -= rate * (g / n + decay * w[f])
            b -= rate * 0.1 * g
    return UrlModel(w.astype(np.float32), float(b), bits)


def judge(pages: DataFrame, model: UrlModel, rules: tuple[UrlRule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every url; only the url column is read.

    The model sees host and path alone; equal ones of a batch are scored once.
    """

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        keys = pd.MultiIndex.from_arrays([host, path])
        codes, kinds = pd.factorize(keys)
        return pd.Series(np.array([model.score(h, p) for h, p in kinds])[codes] if len(kinds) else [], dtype=float)

    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("score", score("host", "path"))
    verdict = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    for kind in sorted({r.verdict for r in rules}):
        verdict = F.when(F.col("rule").isin(*[r.rule for r in rules if r.verdict == kind]), F.lit(kind)).otherwise(verdict)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
