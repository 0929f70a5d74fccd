"""Best-fit packing of tokenised documents into sequences of fixed capacity, by linear grouping.

1. Every document becomes token ids and an end id; one longer than the capacity is cut into full
   pieces, the first of which may be shorter.
2. The histogram of piece lengths (at most `capacity` numbers, whatever the corpus size) goes to the
   driver. Large pieces, in order of falling length, fall into groups of equal cardinality; each group
   is rounded up to its longest member, so that only a few sizes are left. A linear programme over
   configurations (multisets of these sizes that fit a sequence) is solved by column generation.
3. Whole multiples of configurations are laid out and the actual pieces substituted for the rounded
   ones, all but the smallest of a configuration; as only the histogram is needed for that, the fill
   of every sequence is known exactly.
4. Small pieces, and the large ones without a place yet, go best-fit by falling length into the
   sequences with the least room, again by histogram.

The plan is a list of runs "pieces of length L with ranks a..b go to sequences from s on", whose size
depends on the capacity alone. Executors rank pieces within their length, by buckets of the id's hash,
and look up their run. No task holds a length, and no row but the histogram reaches the driver.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LONG_CHUNK, codec
from .common import map_texts, settle, texts_of, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_starts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens: all of `capacity`, but the first, which takes the remainder."""
    first = n if n <= capacity else n % capacity or capacity
    return [0, *range(first, n, capacity)]


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file and their ids."""
    with open(tokenizer_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def tokenised_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int, end_id: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of every document; a null or empty text is the end id alone.

    The rank file and the tokenizer file of a vocabulary give the same ids; the rank file is read, as
    its encoder is several times faster. It has no added tokens: texts are cut at the strings of
    `added`, which get their ids, and what is between them is encoded by itself.
    """
    added = added or {}
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encoded(c, text: str) -> bytes:
        if cut is None or not cut.search(text):
            return c.encode_packed(text, LONG_CHUNK)
        # split() gives the texts between at even places, the added tokens at odd ones.
        return b"".join(np.array([added[part]], "<u4").tobytes() if k % 2 else bytes(c.encode_packed(part, LONG_CHUNK)) for k, part in enumerate(cut.split(text)))

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        end = np.array([end_id], "<u4").tobytes()
        rows: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            packed = memoryview(encoded(c, text) + end)
            n = len(packed) // 4
            starts = cut_starts(n, capacity)
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                for column, value in zip(rows, (doc_id, k, a, b - a, zlib.crc32(packed[4 * a : 4 * b])), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return {n: pa.array(v, k) for n, v, k in zip(("doc_id", "piece", "start", "length", "ids_crc32"), rows, kinds, strict=True)}

    return map_texts(docs, PIECES, work)


@dataclass
class Plan:
    """Runs of (length, first rank, pieces, first sequence, pieces a sequence, offset of the first)."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.runs), np.int64).reshape(-1, 6)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Columns (counts of each size) and their fractional multiples: the least number of sequences.

    Revised simplex; a knapsack over the dual prices finds the next configuration.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    deepest = int(capacity // sizes.min())
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        took = []
        for _ in range(deepest):
            options = np.full((m, capacity + 1), -1.0)
            for g in range(m):
                options[g, sizes[g] :] = best[: capacity + 1 - sizes[g]] + price[g]
            pick = options.argmax(axis=0)
            value = options[pick, np.arange(capacity + 1)]
            better = value > best + 1e-12
            took.append(np.where(better, pick, -1))
            best = np.where(better, value, best)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), capacity
        for picks in reversed(took):
            if picks[room] >= 0:
                column[picks[room]] += 1
                room -= sizes[picks[room]]
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        x = np.maximum(x, 0)
    return basis, x


def plan_packing(histogram: dict[int, int], capacity: int, groups: int = 128, small_share: int = 3) -> Plan:
    """Lays out a histogram {length: pieces}; lengths from capacity // small_share on count as large."""
    plan = Plan(capacity)
    left = {int(k): int(v) for k, v in histogram.items() if v}
    used = dict.fromkeys(left, 0)
    if (full := left.pop(capacity, 0)) > 0:
        plan.runs.append((capacity, 0, full, 0, 1, 0))
        plan.sequences = full
    room: dict[int, list[list[int]]] = {}  # free tokens: runs of (first sequence, sequences)

    large = sorted((n for n in left if n >= max(1, capacity // small_share)), reverse=True)
    if large:
        lengths = np.array(large)
        ends = np.cumsum([left[n] for n in large])
        total = int(ends[-1])
        each = -(-total // groups)
        bounds = [*range(0, total, each), total]
        sizes = lengths[np.searchsorted(ends, bounds[:-1], side="right")]
        demand = np.diff(bounds)
        # Neighbouring groups that round to one size are one size to the programme.
        kinds, inverse = np.unique(-sizes, return_inverse=True)
        sizes, demand = -kinds, np.bincount(inverse, weights=demand).astype(np.int64)
        firsts = np.concatenate([[0], np.cumsum(demand)])
        columns, multiples = configurations(sizes, demand.astype(float), capacity)
        at, stop = firsts[:-1].copy(), firsts[1:]
        for k in range(len(sizes)):
            config = np.rint(columns[:, k]).astype(np.int64)
            times = int(multiples[k] + 1e-6)
            slots = [g for g in range(len(sizes)) for _ in range(config[g])]
            if slots:
                times = min(times, *(int((stop[g] - at[g]) // config[g]) for g in set(slots)))
            if times <= 0:
                continue
            # The smallest place of a configuration stays open: best fit fills it by actual lengths, and so
            # wins back what rounding up cost the others.
            slots = slots[:-1] if len(slots) > 1 else slots
            begun = []
            for g in slots:
                begun.append(int(at[g]))
                at[g] += times
            # Between two changes of a slot's actual length every sequence has the same fill.
            turns = {0, times}
            for b in begun:
                turns.update(int(e - b) for e in ends[np.searchsorted(ends, b, side="right") :] if e - b < times)
            turns = sorted(turns)
            for lo, hi in zip(turns, turns[1:], strict=False):
                offset = 0
                for b in begun:
                    j = int(np.searchsorted(ends, b + lo, side="right"))
                    n = int(lengths[j])
                    plan.runs.append((n, b + lo - int(ends[j] - left[n]), hi - lo, plan.sequences + lo, 1, offset))
                    offset += n
                room.setdefault(capacity - offset, []).append([plan.sequences + lo, hi - lo])
            plan.sequences += times
        # What is left of each size is a stretch of the order; its ranks follow the used ones.
        rest: dict[int, list[tuple[int, int]]] = {}
        for g in range(len(sizes)):
            a = int(at[g])
            while a < stop[g]:
                j = int(np.searchsorted(ends, a, side="right"))
                b = min(int(stop[g]), int(ends[j]))
                n = int(lengths[j])
                rest.setdefault(n, []).append((a - int(ends[j] - left[n]), b - a))
                a = b
    else:
        rest = {}
    stretches = {n: rest.get(n, []) if n in set(large) else [(0, left[n])] for n in left}
    _best_fit(plan, room, stretches, used)
    return plan


def _best_fit(plan: Plan, room: dict[int, list[list[int]]], stretches: dict[int, list[tuple[int, int]]], used: dict[int, int]) -> None:
    """Pieces by falling length, each to the sequence with the least room that holds it; equal ones at once."""
    capacity = plan.capacity
    rooms = np.zeros(capacity + 1, bool)
    for r, runs in room.items():
        rooms[r] = bool(runs)

    def put(free: int, first: int, count: int) -> None:
        if free > 0:
            room.setdefault(free, []).append([first, count])
            rooms[free] = True

    for n in sorted(stretches, reverse=True):
        for rank, count in stretches[n]:
            while count:
                fits = np.flatnonzero(rooms[n:])
                if len(fits):
                    free = n + int(fits[0])
                    first, many = room[free].pop()
                    rooms[free] = bool(room[free])
                else:
                    free, first = capacity, plan.sequences
                    many = max(1, count // (capacity // n))
                    plan.sequences += many
                each = free // n
                whole = min(many, count // each)
                if whole:
                    plan.runs.append((n, rank, whole * each, first, each, capacity - free))
                    put(free - each * n, first, whole)
                    rank, count = rank + whole * each, count - whole * each
                if whole < many:
                    if count:  # fewer than fill one sequence
                        plan.runs.append((n, rank, count, first + whole, each, capacity - free))
                        put(free - count * n, first + whole, 1)
                        rank, count, whole = rank + count, 0, whole + 1
                    if whole < many:
                        put(free, first + whole, many - whole)


def assign(pieces: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Adds sequence_id and offset. A piece's rank within its length: its place in a bucket, after the bucket's predecessors."""
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    keyed = pieces.withColumn("_bucket", key)
    counts = keyed.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("_bucket", "length", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = keyed.withColumn("_place", place).join(before, ["_bucket", "length"]).withColumn("_rank", F.col("_before") + F.col("_place") - 1)
    runs = plan.arrays()
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def look_up(batches):
        for batch in batches:
            cols = {n: np.asarray(batch.column(i)) for i, n in enumerate(batch.schema.names) if n in ("length", "_rank")}
            run = runs[np.searchsorted(keys, (cols["length"] << 48) + cols["_rank"], side="right") - 1] if len(runs) else np.zeros((batch.num_rows, 6), np.int64)
            k = cols["_rank"] - run[:, 1]
            each = np.maximum(run[:, 4], 1)
            out = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(run[:, 3] + k // each), pa.array(run[:, 5] + k % each * cols["length"])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(tidy(look_up), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, groups: int = 128, added: dict[str, int] | None = None) -> DataFrame:
    """Packs the texts of docs (doc_id, text; further columns are ignored). An empty table gives an empty result.

    Null and empty texts are one end id; null ids stay null; repeated rows are packed each.
    """
    pieces = settle(tokenised_pieces(docs, ranks_path, pattern, capacity, end_id, added))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    buckets = 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.rdd.getNumPartitions())
    return assign(pieces, plan_packing(histogram, capacity, groups), buckets)
