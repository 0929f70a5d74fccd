"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order, frozen after training: for every context of
up to ORDER bytes, how often each byte followed it. The cost of a byte is its exact code length: in
the longest known context a byte seen there costs its share of n + d (n occurrences, d distinct
bytes); one that wasn't costs the escape d / (n + d) and is tried in the next shorter context, at
last as one of 256. A text's cost under a language is the sum over all its bytes; the lowest wins.

Costs depend on a byte and the ORDER bytes before it, so each such gram is worked out once per worker
and looked up afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, map_texts, texts_of

#: Bytes of the longest context; a gram fills an unsigned 32-bit number.
ORDER = 3
#: Training rows for each language, about, and the longest of them in characters.
PER_LANGUAGE, LONGEST = 400, 20_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def grams(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it in its text, zero before the start; most significant first."""
    n = len(raw)
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    out = raw.astype(np.uint32)
    for k in range(1, ORDER + 1):
        before = np.zeros(n, np.uint32)
        before[k:] = raw[: n - k]
        before[since < k] = 0
        out |= before << np.uint32(8 * k)
    return out


@dataclass
class ContextTree:
    """For each order: sorted contexts with their totals and distinct bytes, sorted grams with their counts."""

    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]
    seen: list[np.ndarray]
    counts: list[np.ndarray]

    @staticmethod
    def learn(keys: np.ndarray) -> ContextTree:
        tree = ContextTree([], [], [], [], [])
        for order in range(ORDER + 1):
            part = keys & np.uint32((1 << (8 * (order + 1))) - 1) if order < ORDER else keys
            seen, counts = np.unique(part, return_counts=True)
            contexts, at = np.unique(seen >> np.uint32(8), return_index=True)
            tree.seen.append(seen)
            tree.counts.append(counts)
            tree.contexts.append(contexts)
            tree.totals.append(np.add.reduceat(counts, at) if len(at) else counts)
            tree.distinct.append(np.diff(np.append(at, len(seen))))
        return tree

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Exact code length of each gram's last byte after its context."""
        cost, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        for order in range(ORDER, -1, -1):
            part = keys & np.uint32((1 << (8 * (order + 1))) - 1) if order < ORDER else keys
            if not len(self.seen[order]):
                continue
            at = np.minimum(np.searchsorted(self.contexts[order], part >> np.uint32(8)), len(self.contexts[order]) - 1)
            known = open_ & (self.contexts[order][at] == part >> np.uint32(8))
            whole = self.totals[order][at] + self.distinct[order][at]
            g = np.minimum(np.searchsorted(self.seen[order], part), len(self.seen[order]) - 1)
            hit = known & (self.seen[order][g] == part)
            cost[hit] += np.log2(whole[hit] / self.counts[order][g[hit]])
            escape = known & ~hit
            cost[escape] += np.log2(whole[escape] / self.distinct[order][at[escape]])
            open_ &= ~hit
        cost[open_] += 8
        return cost


@dataclass
class LanguageModel:
    languages: list[str]
    trees: list[ContextTree]

    @staticmethod
    def learn(rows: list[tuple[str, str]]) -> LanguageModel:
        languages = sorted({lang for lang, _ in rows})
        trees = []
        for lang in languages:
            texts = [t.encode() for x, t in rows if x == lang and t]
            raw = np.frombuffer(b"".join(texts), np.uint8)
            starts = np.cumsum([0, *map(len, texts)])[:-1] if texts else np.zeros(0, np.int64)
            trees.append(ContextTree.learn(grams(raw, starts)))
        return LanguageModel(languages, trees)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(keys) for t in self.trees], axis=1) if self.trees else np.zeros((len(keys), 0))


class Scorer:
    """Code lengths of whole texts; remembers grams in a table of fixed size, whose slots are overwritten."""

    def __init__(self, model: LanguageModel, slots: int = 20, block: int = 1 << 19):
        self.model, self.shift, self.block = model, np.uint32(32 - slots), block
        self.tags = np.zeros(1 << slots, np.uint32)
        self.known = np.zeros(1 << slots, bool)
        self.table = np.zeros((1 << slots, len(model.languages)), np.float32)

    def gram_bits(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys * np.uint32(0x9E3779B1)) >> self.shift
        out = self.table[slot]
        miss = np.flatnonzero((self.tags[slot] != keys) | ~self.known[slot])
        if len(miss):
            new, where = np.unique(keys[miss], return_inverse=True)
            bits = self.model.bits(new).astype(np.float32)
            out[miss] = bits[where]
            place = (new * np.uint32(0x9E3779B1)) >> self.shift
            self.tags[place], self.known[place], self.table[place] = new, True, bits
            # Where two new grams met in a slot, the row and the tag of the last one stand there.
        return out

    def text_bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.model.languages)))
        full = np.flatnonzero(sizes)
        keys = grams(raw, offsets[:-1][full])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for a in range(0, len(raw), self.block):
            bits = self.gram_bits(keys[a : a + self.block])
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(owner[a : a + self.block], weights=bits[:, j], minlength=len(sizes))
        return out


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> list[tuple[str, str]]:
    """A bounded sample (lang, text): about per_language rows for each language, chosen by the id's hash, of at most `longest` characters.

    A language without a text as short as that is learnt from the first `longest` characters of its long ones.
    """
    rows = docs.filter(F.col("lang").isNotNull() & (F.char_length("text") > 0)).withColumn("short", F.char_length("text") <= longest)
    counts = {r["lang"]: (r["shorts"], r["n"]) for r in rows.groupBy("lang").agg(F.count_if("short").alias("shorts"), F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    chance = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 40))
    rate = F.lit(0)
    for lang, (shorts, n) in sorted(counts.items()):
        rate = F.when((F.col("lang") == lang) & (F.col("short") if shorts else F.lit(True)), F.lit(min(1 << 40, (per_language << 40) // (shorts or n)))).otherwise(rate)
    return sorted((r["lang"], r["text"]) for r in rows.filter(chance < rate).select("lang", F.substring("text", 1, longest).alias("text")).collect())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) from the text alone. A null text, or one without a letter, is `und` with score 0.

    score: the probability of the language, were all equally likely and the code lengths right.
    """

    def setup():
        scorer = Scorer(model)

        def work(batch: pa.RecordBatch) -> dict:
            bits = scorer.text_bits(*byte_view(batch))
            texts = texts_of(batch)
            spoken = np.array([bool(_LETTER.search(t)) for t in texts])
            if bits.shape[1]:
                best = bits.argmin(axis=1)
                gap = np.clip(bits - bits.min(axis=1, keepdims=True), 0, 1000)
                score = 1 / np.exp2(-gap).sum(axis=1)
                lang = [model.languages[b] if s else UNKNOWN for b, s in zip(best, spoken, strict=True)]
            else:
                score, lang = np.zeros(len(texts)), [UNKNOWN] * len(texts)
            return {"doc_id": batch.column(0).cast(pa.int64()), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(np.where(spoken, score, 0.0), pa.float64())}

        return work

    return map_texts(docs, "doc_id long, lang_pred string, score double", None, setup=setup)
