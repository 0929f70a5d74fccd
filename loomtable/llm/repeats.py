"""Suffix-array dedup: bytes inside strings of MIN_LENGTH bytes that start in two places or more.

1. Anchors. Of the GRAM-byte strings inside each MIN_LENGTH-byte window the one with the least hash is
   its anchor, so equal windows have equal anchors at equal places. Consecutive windows with one anchor
   are a run; a run's bytes are a fragment.
2. Counting. Anchors that occur once are dropped: their windows are unique. Fragments that occur
   twice or more are repeated as a whole, however often they occur. Only where an anchor has several
   different fragments is anything left to decide, and only then are bytes fetched, once for each
   different fragment.
3. Interval expansion. These fragments, some megabytes at a time, are joined into a text; its suffixes
   are sorted, and the Burrows-Wheeler transform is extended backwards, breadth first: intervals of
   strings of length l give those of length l + 1, and an interval's end whose common prefix with its
   successor isn't known yet has l. Common prefixes so appear by increasing value, and the search stops
   at MIN_LENGTH; what is unknown then is at least that long, and marks repeated windows.
4. An anchor with more than HOT different fragments (a passage that many documents share, with other
   text around it) isn't given to one task: its fragments are cut again with longer anchors, which
   contain more of what surrounds them, along a ladder. At its end an anchor is a whole window.
5. Two lengths. Where spans of a shorter length are wanted too, they are found first: a string of MIN_LENGTH
   bytes that occurs twice lies wholly inside one of them, so the steps above then read these spans only.

Matches don't cross documents. A null text is an empty one; repeated rows are repeats of each other;
null ids are allowed. Texts shorter than MIN_LENGTH keep all their bytes.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, discard, settle, sifted, text_slices, tidy
from .shingles import mix

MIN_LENGTH = 400
#: Different fragments of an anchor that one task takes, and bytes that it sorts at once.
HOT, SORTED = 2048, 1 << 20
#: Bytes of text that are cut into runs at once; hashes and their minima take about a hundred times as much.
CUT = 1 << 19
_PLACE = 24


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of an odd base and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    ups, downs = (np.cumprod(np.array([1] + [b] * n, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
    return np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64), ups, downs


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each place on."""
    n = len(raw) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = 1 << max(16, int(len(raw)).bit_length())
    value, ups, downs = _powers(size)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value[raw] * ups[: len(raw)], out=total[1:])
    return mix((total[gram:] - total[:n]) * downs[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from least of blocks' heads and tails."""
    if width == 1:
        return x
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(-1, width)
    heads = np.minimum.accumulate(grid, axis=1).reshape(-1)
    tails = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tails[:n], heads[width - 1 : width - 1 + n])


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, gram: int, length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and windows of every run; raw has at most 2 ** 24 bytes, of several texts."""
    hashes = gram_hashes(raw, gram)
    ok = np.zeros(max(0, len(raw) - length + 1), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            ok[a : b - length + 1] = True
    if not ok.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << _PLACE) - 1)
    least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    place = (least & low).astype(np.int64)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(ok))
    last = np.flatnonzero(ok & ~np.append(ok[1:], False)) + 1  # where a text's windows end
    ends = last[np.searchsorted(last, starts, side="right")]
    return hashes[place[starts]], starts, np.minimum(stops, ends) - starts


def _chunks(raw: np.ndarray, offsets: np.ndarray, length: int, limit: int = CUT):
    """A single text longer than the limit in parts that overlap by a window less one; (bytes, offsets, text, base)."""
    if len(raw) <= limit:
        yield raw, offsets, None, 0
        return
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, max(a + 1, b - length + 1), limit):
            part = raw[at : min(b, at + limit + length - 1)]
            yield part, np.array([0, len(part)]), k, at - a


# --- the Burrows-Wheeler transform of fragments


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the first `depth` symbols from there on, by doubling; symbols are 0 to 256, 0 beyond the end."""
    n, step = len(text), 7
    wide = np.zeros(n + step, np.uint64)
    wide[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(step):
        key = key * np.uint64(257) + wide[k : n + k]
    while True:
        order = np.argsort(key)  # equal keys in any order: what is asked of an interval doesn't depend on it
        ranked = key[order]
        rank = np.zeros(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)])).astype(np.uint64)
        if step >= depth or rank[order[-1]] == n:
            return order
        key = rank << np.uint64(32)
        key[: n - step] |= rank[step:] if step < n else 0
        step *= 2


def long_common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place of it whether `length` symbols are shared with its predecessor.

    Separators are 0; nothing is extended over them, so suffixes that begin with one stay unjudged.
    """
    n = len(text)
    order = sorted_suffixes(text, length)
    before = text[order - 1]  # of the first place, the last symbol: a separator
    by = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[by] = np.arange(n)  # last-to-first mapping
    same = before[by[1:]] == before[by[:-1]]
    following, leading = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by[:-1][same]] = by[1:][same]
    leading[by[1:][same]] = by[:-1][same]
    unknown = np.ones(n + 1, bool)
    unknown[0] = unknown[n] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for level in range(length):
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        first, last = np.repeat(lo, size), np.repeat(hi, size)
        if level:
            use = before[at] != 0
            at, first, last = at[use], first[use], last[use]
        # Equal symbols of an interval map to one interval, from its first to its last of them; those of
        # a level don't overlap, so sorted beginnings and ends belong together.
        lo = np.sort(to[at[leading[at] < first]])
        hi = np.sort(to[at[following[at] >= last]]) + 1
        new = unknown[hi] | (hi == n) if not level else unknown[hi]
        unknown[hi] = False
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
    return order, unknown[:n]


def repeated_windows(fragments: list[bytes], length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For each fragment, whether the window from each place on occurs twice or more among all fragments."""
    sizes = np.array([len(f) for f in fragments], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(int(starts[-1]), np.uint16)
    for f, a in zip(fragments, starts.tolist(), strict=False):
        text[a : a + len(f)] = np.frombuffer(f, np.uint8).astype(np.uint16) + 1
    order, long = long_common_prefixes(text, length)
    again = np.zeros(len(text), bool)
    hits = np.flatnonzero(long)
    again[order[hits]] = again[order[hits - 1]] = True
    return [again[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=False)]


# --- in Spark


def _tag(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(text)


def _run_rows(units: DataFrame, gram: int, length: int) -> DataFrame:
    """(anchor, frag, doc_id, tag, base, start, n): the runs of units (doc_id, tag, base, text binary); start counts from the document's."""
    schema = "anchor long, frag long, doc_id long, tag long, base long, start long, n int"

    def run(batches):
        for batch in text_slices(batches, limit=CUT):
            raw, offsets = byte_view_binary(batch)
            for part, cuts, text, shift in _chunks(raw, offsets, length):
                anchors, starts, n = anchor_runs(part, cuts, gram, length)
                view = memoryview(part)
                frag = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + k + length - 1]) for a, k in zip(starts.tolist(), n.tolist(), strict=True)), np.uint64, len(starts))
                owner = np.searchsorted(cuts, starts, side="right") - 1 if text is None else np.full(len(starts), text)
                within = starts - cuts[owner] if text is None else starts + shift
                pick = pa.array(owner)
                base = batch.column(2).take(pick)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(frag.view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick), base, pa.array(np.asarray(base) + within), pa.array(n.astype(np.int32))], ["anchor", "frag", "doc_id", "tag", "base", "start", "n"])

    return units.select("doc_id", "tag", "base", "text").mapInArrow(tidy(run), schema)


def byte_view_binary(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """As byte_view, of a binary column `text`."""
    at = batch.schema.get_field_index("text")
    return byte_view(pa.RecordBatch.from_arrays([batch.column(at).cast(pa.large_binary()).view(pa.large_string())], ["text"]))


def _fetch(units: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, done, doc_id, tag, base, text) of the wanted runs: their bytes, cut from their units.

    Only units that may hold a wanted run are shuffled.
    """
    key = F.xxhash64("doc_id", "tag", "base")
    units, _ = sifted(units, key, wanted, key)
    lists = wanted.groupBy("doc_id", "tag", "base").agg(F.collect_list(F.struct("anchor", "done", "start", "n")).alias("runs"))
    lists = lists.select(*[F.col(c).alias("_" + c) for c in ("doc_id", "tag", "base")], "runs")
    joined = units.join(lists, units.doc_id.eqNullSafe(lists._doc_id) & (units.tag == lists._tag) & (units.base == lists._base))

    def cut(batches):
        for batch in text_slices(batches):
            rows = []
            for doc_id, tag, base, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in runs:
                    at = r["start"] - base
                    rows.append((r["anchor"], r["done"], doc_id, tag, r["start"], text[at : at + r["n"] + length - 1]))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["anchor", "done", "doc_id", "tag", "base", "text"])

    return joined.select("doc_id", "tag", "base", "text", "runs").mapInArrow(tidy(cut), "anchor long, done boolean, doc_id long, tag long, base long, text binary")


SPANS = "doc_id long, tag long, start long, stop long"


def _expanded(fragments: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of fragments, judged among those with the same anchor."""

    def run(batches):
        held: list[tuple] = []
        size, anchor = 0, None

        def judge():
            rows = []
            for (_, done, doc_id, tag, base, text), again in zip(held, repeated_windows([r[5] for r in held], length), strict=True):
                if done or not again.any():
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
                rows += [(doc_id, tag, base + a, base + b - 1 + length) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "tag", "start", "stop"])

        for batch in text_slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != anchor and size > SORTED:
                    yield judge()
                    held, size = [], 0
                anchor = row[0]
                held.append(row)
                size += len(row[5])
        if held:
            yield judge()

    return fragments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(run), SPANS)


def ladder(length: int) -> tuple[int, ...]:
    """Lengths of anchors for a minimum length, up to a whole window."""
    return tuple(sorted({max(1, length * share // 100) for share in (32, 84, 98, 100)}))


def _whole_units(docs: DataFrame) -> DataFrame:
    """Every text of docs as a unit of its own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", _tag(text).alias("tag"), F.lit(0).cast("long").alias("base"), text.cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, length: int = MIN_LENGTH, grams: tuple[int, ...] | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, tag, start, stop), a settled table: maximal spans of bytes of all repeated windows."""
    return _spans_of(_whole_units(docs), length, grams or ladder(length), hot)


def nested_spans(docs: DataFrame, length: int, shorter: int, grams: tuple[int, ...] | None = None, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """repeated_spans of two lengths, that of `length` first; it is looked for inside the spans of the shorter one."""
    if not 0 < shorter <= length:
        raise ValueError(f"{shorter} is not a length of 1 to {length}")
    short = repeated_spans(docs, shorter, hot=hot)
    size, none = F.col("stop") - F.col("start"), F.lit(0).cast("long")
    wide = short.filter(size >= length).select(none.alias("anchor"), F.lit(False).alias("done"), "doc_id", "tag", none.alias("base"), "start", (size - (length - 1)).cast("int").alias("n"))
    inside = settle(_fetch(_whole_units(docs), wide, length).select("doc_id", "tag", "base", "text"))
    return _spans_of(inside, length, grams or ladder(length), hot), short


def _spans_of(units: DataFrame, length: int, grams: tuple[int, ...], hot: int) -> DataFrame:
    """The repeated windows of units as maximal spans of their documents; settled units are removed."""
    spans: list[DataFrame] = []
    for level, gram in enumerate(grams):
        every = settle(_run_rows(units, gram, length))
        # Settled, so that the join deals both sides itself and may split an anchor that many documents have.
        twice = settle(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("total"), (F.min("frag") != F.max("frag")).alias("several")).filter("total > 1").select("anchor", "several"))
        runs = settle(every.join(twice, "anchor"))
        discard(every, twice)
        kinds = settle(runs.groupBy("anchor", "frag").agg(F.count(F.lit(1)).alias("times"), F.first("several").alias("several"), F.min(F.struct("doc_id", "tag", "base", "start", "n")).alias("one")))
        whole = runs.join(kinds.filter("times > 1").select("anchor", "frag"), ["anchor", "frag"])
        spans.append(settle(whole.select("doc_id", "tag", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))))
        discard(runs)
        several = settle(kinds.filter("several").select("anchor", (F.col("times") > 1).alias("done"), "one.*"))
        discard(kinds)
        crowds = settle(several.groupBy("anchor").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > hot).select("anchor"))
        last = level + 1 == len(grams) or not crowds.take(1)
        few = several if last else settle(several.join(crowds, "anchor", "left_anti"))
        spans.append(settle(_expanded(_fetch(units, few, length), length)))
        if last:
            discard(several, crowds, units)
            break
        many = settle(several.join(crowds, "anchor", "left_semi"))
        discard(several, crowds, few)
        deeper = settle(_fetch(units, many, length).select("doc_id", "tag", "base", "text"))
        discard(units, many)
        units = deeper
    return joined_spans(spans)


def joined_spans(spans: list[DataFrame]) -> DataFrame:
    """Maximal spans of each document, settled: spans that overlap or touch are one."""
    every = spans[0]
    for more in spans[1:]:
        every = every.union(more)
    order = Window.partitionBy("doc_id", "tag").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = every.withColumn("_new", F.when(reach >= F.col("start"), F.lit(0)).otherwise(F.lit(1)))
    numbered = begun.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = settle(numbered.groupBy("doc_id", "tag", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run"))
    discard(*spans)
    return out


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, spans): every row of docs as a struct, and the sorted spans (start, stop and further columns) of its text or null.

    Only texts that may have spans are shuffled to meet them.
    """
    told = F.struct(*[c for c in spans.columns if c not in ("doc_id", "tag")])
    lists = spans.groupBy(F.col("doc_id").alias("id"), "tag").agg(F.sort_array(F.collect_list(told)).alias("spans"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", _tag(F.coalesce("text", F.lit(""))).alias("own"))
    some, none = sifted(keyed, F.xxhash64("doc_id", "own"), spans, F.xxhash64("doc_id", "tag"))
    found = some.join(lists, some.doc_id.eqNullSafe(lists.id) & (some.own == lists.tag), "left").select("row", "spans")
    return found.union(none.select("row", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans")))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; runs that touch are one."""
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [(a, b) for a, b in out]


def kept_parts(raw: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    """What is left before, between and after the runs."""
    ends = [0, *(b for _, b in runs)]
    return [raw[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(raw)], strict=True)]


def removed_digests(docs: DataFrame, length: int = MIN_LENGTH, grams: tuple[int, ...] | None = None, hot: int = HOT, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    With `passage`, a shorter length, there is a last column n_passage_bytes: the bytes inside strings of that many
    bytes which start in two places or more. They count what is removed too, and change nothing about it.
    """
    docs = docs.select("doc_id", "text")
    if passage is None:
        spans = repeated_spans(docs, length, grams, hot).withColumn("whole", F.lit(True))
    else:
        long, short = nested_spans(docs, length, passage, grams, hot)
        spans = long.withColumn("whole", F.lit(True)).union(short.withColumn("whole", F.lit(False)))
    rows = _with_spans(docs, spans).select("row.doc_id", F.coalesce("row.text", F.lit("")).alias("text"), "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_passage_bytes long" if passage else "")

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        for batch in text_slices(batches):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, runs = text.encode(), merged([s for s in spans or () if s["whole"]])
                again = sum(b - a for a, b in merged(spans)) if passage else 0
                for c, v in zip(cols, (len(raw), sum(b - a for a, b in runs), len(runs), sha256(b"".join(kept_parts(raw, runs))).hexdigest(), again), strict=True):
                    c.append(v)
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))][: len(names)], names)

    return rows.mapInArrow(tidy(run), schema)


def without_repeats(docs: DataFrame, length: int = MIN_LENGTH, grams: tuple[int, ...] | None = None, hot: int = HOT) -> DataFrame:
    """docs, all columns, with repeated bytes cut from text; null texts stay null, n_chars follows the text.

    A character of which a part is cut goes as a whole: each part that is left is decoded by itself.
    """
    columns = docs.columns
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    rows = _with_spans(docs, repeated_spans(docs.select("doc_id", "text"), length, grams, hot)).select("row.*", "spans")
    at, schema = columns.index("text"), docs.schema

    def run(batches):
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            names[at] = "text"
            for part in text_slices([pa.RecordBatch.from_arrays(batch.columns, names)]):
                texts, cut = [], []
                for text, spans in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    if spans:
                        text = "".join(part.decode("utf-8", "ignore") for part in kept_parts(text.encode(), merged(spans)))
                    cut.append(bool(spans))
                    texts.append(text)
                cols = list(part.columns[:-1])
                cols[at] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    k = columns.index("n_chars")
                    cols[k] = pa.array([len(t) if c else n for t, c, n in zip(texts, cut, cols[k].to_pylist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(cols, columns)

    return rows.mapInArrow(tidy(run), schema)
