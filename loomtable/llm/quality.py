"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. The features of a line are measures of its bytes, together with those of
the lines before and after it; a transition matrix ties neighbouring labels. Forward-backward gives
each line's marginal probability of being good; their mean, weighted by line length, calibrated by a
logistic curve, is the document's quality. Lines learn the label of their document.

A text is its lines between newlines, so an empty or null text is one empty line. Forward and backward
messages are prefix products of 2 x 2 matrices, computed by doubling over all lines of a batch, so the
length of a text bounds neither the passes (its logarithm does) nor the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, hash_part, map_texts, text_slices, tidy

#: Labelled rows that are learnt from, about, and the longest of them in characters.
SAMPLE, LONGEST = 2000, 20_000
#: Bytes whose features are worked out at once.
BLOCK_BYTES = 1 << 19
#: Kinds of bytes: upper case, lower case, digit, space, stop or comma, shouting mark, symbol, bar, other ASCII, beyond ASCII.
KINDS = 10


def _kinds() -> np.ndarray:
    k = np.full(256, 8, np.int64)
    for i, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\n", ".,;:", "!?", "#*$%&<>@^~=+_", "|")):
        for c in chars:
            k[ord(c)] = i
    k[128:] = 9
    return k


KIND_OF = _kinds().astype(np.uint8)


def split_lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the first line of each text (with their number at the end)."""
    cuts = np.flatnonzero(raw == 10)
    per_text = np.searchsorted(cuts, offsets[1:]) - np.searchsorted(cuts, offsets[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    head, tail = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    starts[head], ends[tail] = offsets[:-1], offsets[1:]
    starts[~head], ends[~tail] = cuts + 1, cuts
    return starts, ends, first


def line_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of all lines, block by block: what a block of bytes needs besides is a small multiple of it."""
    out = np.zeros((len(starts), FEATURES), np.float32)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right")))
        a, b = starts[at], ends[to - 1]
        out[at:to] = _block_features(raw[a:b], starts[at:to] - a, ends[at:to] - a)
        at = to
    return out


#: Numbers of a line.
FEATURES = 2 * KINDS + 10


def _block_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shares of the kinds of bytes, their squeezed forms, size, words and how the line ends."""
    size = (ends - starts).astype(np.float64)
    kind = KIND_OF[raw]
    counts = np.empty((len(starts), KINDS))
    for k in range(KINDS):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)])
        counts[:, k] = total[ends] - total[starts]
    words = counts[:, 3] + (size > 0)
    share = counts / np.maximum(size, 1)[:, None]
    last = kind[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(len(starts), np.uint8)
    full = size > 0
    again = word_repeats(raw, starts, ends) / np.maximum(words, 1)
    return np.column_stack([share, np.sqrt(share), again, np.sqrt(again), np.log1p(size) / 8, np.log1p(words) / 6, np.minimum(size / np.maximum(words, 1), 40) / 10, counts[:, 6] / np.maximum(words, 1), counts[:, 5] / np.maximum(words, 1), counts[:, 7] / np.maximum(words, 1), full & (last == 4), ~full])


def word_repeats(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words of each line equal the word before, by size and sums of bytes and of their squares."""
    if not len(raw):
        return np.zeros(len(starts))
    gap = KIND_OF[raw] == 3
    edge = np.zeros(len(raw) + 1, bool)  # texts follow each other without a gap
    edge[starts], edge[ends] = True, True
    begins = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])))
    stops = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]]))) + 1
    flat, square = (np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for v in (raw, raw.astype(np.uint16) ** 2))
    same = np.zeros(len(begins) + 1, np.int64)
    signs = np.stack([stops - begins, flat[stops] - flat[begins], square[stops] - square[begins]])
    same[1:-1] = (signs[:, 1:] == signs[:, :-1]).all(axis=0)
    total = np.concatenate([[0], np.cumsum(same)])
    a, b = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    return np.where(b > a, total[b] - total[np.minimum(a + 1, b)], 0).astype(np.float64)


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, those of its neighbours in the text (zero beyond it), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    return np.column_stack([x, before, after, np.ones(len(x), x.dtype)])


def prefix_products(m: np.ndarray, since: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices from each chain's start to every place, scaled; `since` counts places from the start."""
    m = m.copy()
    step, most = 1, int(since.max()) if len(since) else 0
    while step <= most:
        at = np.flatnonzero(since >= step)
        a, b = m[at - step], m[at]
        p = np.empty_like(b)
        for i in (0, 1):
            for j in (0, 1):
                p[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
        m[at] = p / np.maximum(p.max(axis=(1, 2), keepdims=True), 1e-300)
        step *= 2
    return m


def forward_backward(score: np.ndarray, turn: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each line's two labels, and of each pair (line before, line); score: n x 2, turn: 2 x 2, in logs."""
    n = len(score)
    sizes = np.diff(first)
    since = np.arange(n) - np.repeat(first[:-1], sizes)
    until = np.repeat(first[1:] - 1, sizes) - np.arange(n)
    own = np.exp(score - score.max(axis=1, keepdims=True))
    m = np.exp(turn - turn.max())[None] * own[:, None, :]
    m[first[:-1]] = own[first[:-1]][:, None, :]
    ahead = prefix_products(m, since)[:, 0, :]
    # From behind: the matrix that leads from a line to the next, transposed, in reverse order.
    lead = np.ones((n, 2, 2))
    inner = until > 0
    lead[inner] = m[np.flatnonzero(inner) + 1].transpose(0, 2, 1)
    back = prefix_products(lead[::-1], until[::-1])[::-1][:, 0, :]
    node = ahead * back
    node /= np.maximum(node.sum(axis=1, keepdims=True), 1e-300)
    pair = np.zeros((n, 2, 2))
    k = np.flatnonzero(since > 0)
    pair[k] = ahead[k - 1][:, :, None] * m[k] * back[k][:, None, :]
    pair[k] /= np.maximum(pair[k].sum(axis=(1, 2), keepdims=True), 1e-300)
    return node, pair


@dataclass
class LineField:
    """Weights of a line being good, transitions, and the calibration of the documents' mean."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    turn: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def line_marginals(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) and length of each line, and the first line of each text."""
        starts, ends, first = split_lines(raw, offsets)
        x = (line_features(raw, starts, ends) - self.mean) / self.scale
        good = with_neighbours(x, first) @ self.weights
        node, _ = forward_backward(np.column_stack([np.zeros(len(good)), good]), self.turn, first)
        return node[:, 1], np.maximum(ends - starts, 1).astype(np.float64), first

    def document_means(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p, w, first = self.line_marginals(raw, offsets)
        return np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        m = np.clip(self.document_means(raw, offsets), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * np.log(m / (1 - m)) + self.curve[1], -30, 30)))


def train(texts: list[str], labels: list[int], rounds: int = 150, decay: float = 1e-3) -> LineField:
    """Maximum likelihood by Adam over all chains; both labels weigh the same in the features' scale, not in the likelihood."""
    parts = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    y = np.array(labels, np.int64)
    starts, ends, first = split_lines(raw, offsets)
    x = line_features(raw, starts, ends)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 0.05) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    field = LineField(mean, scale, np.zeros(3 * x.shape[1] + 1), np.zeros((2, 2)))
    if not len(texts) or y.min() == y.max():
        field.weights[-1] = 3.0 if not len(texts) or y[0] == 1 else -3.0  # nothing to learn: the only label
        return field
    x = with_neighbours((x - mean) / scale, first)
    # A long text weighs as much as a short one: each line counts by its chain's size.
    sizes = np.diff(first)
    weight = np.repeat(1 / np.sqrt(sizes), sizes)
    truth = np.repeat(y, sizes)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[inner], truth[inner]), weight[inner])
    theta, m1, m2 = np.zeros(x.shape[1] + 4), 0.0, 0.0
    total = weight.sum()
    for k in range(1, rounds + 1):
        good = x @ theta[:-4]
        node, pair = forward_backward(np.column_stack([np.zeros(len(good)), good]), theta[-4:].reshape(2, 2), first)
        grad = np.concatenate([x.T @ ((node[:, 1] - truth) * weight), ((pair * weight[:, None, None]).sum(axis=0) - seen).ravel()]) / total
        grad += decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta - 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
    field.weights, field.turn = theta[:-4], theta[-4:].reshape(2, 2)
    field.curve = _curve(field.document_means(raw, offsets), y)
    return field


def _curve(means: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope (not below zero) and shift of a logistic curve over the means' log odds, by Newton steps."""
    m = np.clip(means, 1e-6, 1 - 1e-6)
    z = np.column_stack([np.log(m / (1 - m)), np.ones(len(m))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1.0 * np.eye(2)
        w = w - np.linalg.solve(hess, z.T @ (p - y) + 1.0 * (w - np.array([1.0, 0.0])))
    return (float(max(w[0], 1e-3)), float(w[1]))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts (of at most `longest` characters) outside the held-out fold, chosen by the id's hash."""
    usable = labels.filter(F.col("quality").isNotNull() & (hash_part("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = max(1, usable.count())
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40)) < min(1 << 40, (sample << 40) // n))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.char_length("text") <= longest).join(F.broadcast(chosen), "doc_id")  # about `sample` rows
    return sorted((r["text"], int(r["quality"])) for r in rows.select("text", "quality").collect())


def score_documents(docs: DataFrame, field: LineField, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every text; extra columns are left out, repeated rows repeat."""

    def work(batch: pa.RecordBatch) -> dict:
        score = field.score(*byte_view(batch))
        return {"doc_id": batch.column(0).cast(pa.int64()), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())}

    return map_texts(docs, "doc_id long, score double, predicted int", work)


def keep_good(docs: DataFrame, field: LineField, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least the threshold."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            names[at] = "text"
            for part in text_slices([pa.RecordBatch.from_arrays(batch.columns, names)]):
                keep = field.score(*byte_view(part)) >= threshold
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep)).columns, schema.fieldNames())

    return docs.mapInArrow(tidy(run), schema)


def columns(rows: list[tuple[str, int]]) -> tuple[list[str], list[int]]:
    return [t for t, _ in rows], [y for _, y in rows]
