"""Edit-aware token counts: a segment tree of pre-token counts per document.

A document is cut into leaves at pre-token boundaries; every leaf knows its characters and its token
count, and a binary tree holds the sums of both. An edit replaces a range of characters: the tree
finds the leaves that it touches, one leaf of context on either side joins them, only their text is
cut and encoded again, and the sums above them are brought up to date. Where the last boundary of the
re-encoded stretch isn't a boundary of the old text any more, the stretch grows by another leaf.

Counts equal encoding the whole edited text.

Trees outlive a run: tree_table() makes a table of texts with the leaves' sizes and counts, and
edit_trees() takes such a table with edits to the next one; neither cuts nor encodes what no edit touches.

Null and empty texts have no leaves and no tokens; repeated rows keep trees of their own; an empty
table gives an empty table; a very long text is one row, and a stretch of it without single spaces
one leaf. Columns other than doc_id and text (and edits) are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG_CHUNK, Codec, codec
from .common import map_texts, settle

#: Characters of a leaf, about.
LEAF = 256


def safe_cut(text: str, at: int) -> int:
    """The first place from `at` on where a pre-token begins in any reading, or the end: a single space between words."""
    while True:
        at = text.find(" ", at)
        if at < 0:
            return len(text)
        if at and at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at += 1


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while at < len(text):
        to = safe_cut(text, at + size) if at + size < len(text) else len(text)
        out.append(text[at:to])
        at = to
    return out


class SumTree:
    """Binary tree over the leaves' (characters, tokens); node 1 is the root."""

    def __init__(self, values: np.ndarray):
        self.width = 1 << max(0, int(len(values) - 1).bit_length())
        self.node = np.zeros((2 * self.width, 2), np.int64)
        self.node[self.width : self.width + len(values)] = values
        for level in range(self.width.bit_length() - 2, -1, -1):
            a = 1 << level
            self.node[a : 2 * a] = self.node[2 * a : 4 * a : 2] + self.node[2 * a + 1 : 4 * a : 2]

    @property
    def totals(self) -> tuple[int, int]:
        return int(self.node[1, 0]), int(self.node[1, 1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if char - before >= self.node[k, 0] and self.node[k + 1, 0] > 0:
                before += int(self.node[k, 0])
                k += 1
        return k - self.width, before

    def put(self, leaf: int, value: tuple[int, int]) -> None:
        k = leaf + self.width
        self.node[k] = value
        while k > 1:
            k //= 2
            self.node[k] = self.node[2 * k] + self.node[2 * k + 1]


class CountedText:
    """A text whose token count follows edits."""

    def __init__(self, text: str, code: Codec, size: int = LEAF, stored: tuple[list[int], list[int]] | None = None):
        """stored: the characters and tokens of the leaves, where an earlier tree was kept."""
        self.code, self.size, self.reencoded = code, size, 0
        if stored is None:
            self.leaves = leaves_of(text, size)
            self._build([len(code.encode_packed(leaf, LONG_CHUNK)) // 4 for leaf in self.leaves])
        else:
            ends = np.cumsum([0, *stored[0]]).tolist()
            self.leaves = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            self._build(list(stored[1]))

    def _build(self, counts: list[int]) -> None:
        self.counts = counts
        self.tree = SumTree(np.array([[len(a), n] for a, n in zip(self.leaves, counts, strict=True)], np.int64).reshape(-1, 2))

    @property
    def tokens(self) -> int:
        return self.tree.totals[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters [start, end), clipped to the text, by `new`."""
        size = self.tree.totals[0]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if not self.leaves:
            self.leaves = leaves_of(new, self.size)
            self._build([len(self.code.encode_packed(leaf, LONG_CHUNK)) // 4 for leaf in self.leaves])
            self.reencoded += len(new)
            return
        a, before = self.tree.find(start)
        b, _ = self.tree.find(max(start, end - 1))
        lo = max(0, a - 1)
        before -= sum(len(self.leaves[k]) for k in range(lo, a))
        hi = min(len(self.leaves), b + 2)
        old = "".join(self.leaves[lo:hi])
        fresh = old[: start - before] + new + old[end - before :]
        # The next leaf begins with " x": it stays a boundary while white space doesn't precede it.
        while hi < len(self.leaves) and (not fresh or fresh[-1].isspace()):
            fresh += self.leaves[hi]
            hi += 1
        # Likewise the first re-encoded leaf must still begin a pre-token.
        while lo and not (len(fresh) > 1 and fresh[0] == " " and not fresh[1].isspace()):
            lo -= 1
            fresh = self.leaves[lo] + fresh
        leaves = leaves_of(fresh, self.size)
        counts = [len(self.code.encode_packed(leaf, LONG_CHUNK)) // 4 for leaf in leaves]
        self.reencoded += len(fresh)
        same = len(leaves) == hi - lo
        self.leaves[lo:hi] = leaves
        if same:
            self.counts[lo:hi] = counts
            for k, (leaf, n) in enumerate(zip(leaves, counts, strict=True)):
                self.tree.put(lo + k, (len(leaf), n))
        else:  # the number of leaves changed: the sums are built anew, no text is read
            self._build([*self.counts[:lo], *counts, *self.counts[hi:]])


TREES = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>"
_INTS = pa.list_(pa.int32())


def tree_table(docs: DataFrame, ranks_path: str, pattern: str, edits: bool = False) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens) of docs (doc_id, text), with their column of edits if asked for: the trees of all texts, to be kept."""

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        trees = [CountedText(text or "", c) for text in batch.column(1).to_pylist()]
        out = {"doc_id": batch.column(0).cast(pa.int64()), "text": batch.column(1), "leaf_chars": pa.array([[len(leaf) for leaf in t.leaves] for t in trees], _INTS), "leaf_tokens": pa.array([t.counts for t in trees], _INTS)}
        return out | ({"edits": batch.column(2)} if edits else {})

    extra = f", edits {docs.schema['edits'].dataType.simpleString()}" if edits else ""
    return map_texts(docs, TREES + extra, work, columns=("doc_id", "text", *(("edits",) if edits else ())))


def edit_trees(trees: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The trees of a table (doc_id, text, leaf_chars, leaf_tokens, edits) after its edits, with n_tokens (before),
    n_tokens_edited, n_edits, n_chars and n_chars_reencoded.

    edits: array of (start, stop, replacement), applied in order, each to the text that the ones before
    left; null, or a null text, count as none and empty. Null replacements delete.
    """
    numbers = ("n_tokens", "n_tokens_edited", "n_edits", "n_chars", "n_chars_reencoded")

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        rows = []
        for text, chars, tokens, edits in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            t = CountedText(text or "", c, stored=(chars, tokens))
            n = t.tokens
            for e in edits or ():
                t.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
            rows.append((t.text(), [len(leaf) for leaf in t.leaves], t.counts, n, t.tokens, len(edits or ()), t.tree.totals[0], t.reencoded))
        kinds = (pa.string(), _INTS, _INTS, *[pa.int64()] * 5)
        names = ("text", "leaf_chars", "leaf_tokens", *numbers)
        return {"doc_id": batch.column(0)} | {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))}

    return map_texts(trees, TREES + "".join(f", {n} long" for n in numbers), work, columns=("doc_id", "text", "leaf_chars", "leaf_tokens", "edits"))


def count_with_edits(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_edits, n_chars, n_chars_reencoded) of docs (doc_id, text, edits): the trees
    are stored as a table in the shared folder, and the edits are applied to what it holds."""
    kept = settle(tree_table(docs, ranks_path, pattern, edits=True))
    return edit_trees(kept, ranks_path, pattern).drop("text", "leaf_chars", "leaf_tokens")


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the array `edits` from a table (doc_id, seq, start, stop, replacement), in order of seq."""
    ordered = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("edits"))
    ordered = ordered.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["replacement"].alias("replacement"))))
    return docs.select("doc_id", "text").join(ordered, "doc_id", "left")


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each, by length: an insertion at a third, a replacement at a half, a deletion at the end."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    one = lambda a, b, r: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), r.alias("replacement"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return docs.select("doc_id", "text", F.array(one(third, third, F.lit(" inserted words,")), one(half, half + 9, F.lit("replaced")), one(n - 5, n + 30, F.lit(None).cast("string"))).alias("edits"))


