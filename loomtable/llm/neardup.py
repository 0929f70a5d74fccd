"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles.

1. Texts fall into classes of exact copies by their MD5 digest; every further step works on distinct
   texts, so a group of copies of any size is one text.
2. Document frequencies of all shingles of all documents are gathered in a sketch of fixed width.
   A shingle weighs its count in the text times an inverse document frequency damped to [1, 1 + DAMP]:
   undamped, the few edited shingles of a copy in a group of thousands would outweigh what it shares,
   and near copies of common texts would be missed.
3. Consistent weighted sampling draws SAMPLES shingles from each text; two texts draw the same one
   with the probability of their weighted Jaccard similarity. BANDS bands of samples give buckets.
4. Members of a bucket meet in blocks of at most BLOCK texts, dealt by hash, whatever the bucket's
   size. In a block every member is compared with all others by samples; the heaviest spanning forest
   and each member's nearest go on as candidates, never all pairs. The most central member of each
   cluster of a block stands for it in the next level, until one block is left.
5. Candidates are verified: the weighted Jaccard similarity of the two whole texts is computed, and
   0.8 or more is a link.
6. What is left: in each bucket whose members are not all joined by links, every block meets every
   other. Likely similar members that no link joins yet are compared by their whole texts, all pairs of
   them, and links that join two classes are kept. Connected components of links are the classes.

A null text is an empty one. Texts without words are linked only to exact copies. Null ids form
classes like others; repeated rows get the same class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, settle, sifted, text_slices, texts_of, tidy
from .components import connected_components
from .shingles import mix, shingle_sets

SIMILAR = 0.8
#: 12 bands of 4 samples: a pair at 0.8 shares a band with probability 0.998.
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
#: Share of equal samples from which a pair goes to verification: more than three deviations below 0.8.
LIKELY = 0.6
BLOCK = 256
#: Nearest members that each member of a block is verified with, besides the forest.
NEAREST = 4
#: Counters of the frequency sketch, and rows in which a task sends them.
WIDTH, PARTS = 1 << 18, 64
DAMP, RARE = 0.1, 0.002
#: Entries of the tables of random variables.
TABLE = 1 << 13


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


# --- weights


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a shingle of each of WIDTH hash classes, and their number: sums over all rows."""

    def count(batches):
        sums, n = np.zeros(WIDTH, np.int64), 0
        for batch in text_slices(batches):
            sets = shingle_sets(texts_of(batch))
            n += len(sets)
            if sets:
                sums += np.bincount((np.concatenate([s for s, _ in sets]) >> np.uint64(46)).astype(np.int64), minlength=WIDTH)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "n": pa.array([n] * PARTS, pa.int64()), "sums": pa.array([s.astype("<i8").tobytes() for s in sums.reshape(PARTS, -1)], pa.binary())})

    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for part, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = total.setdefault(part, [0, np.zeros(WIDTH // PARTS, np.int64)])
                have[0] += n
                have[1] += np.frombuffer(sums, "<i8")
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "n": pa.array([n for n, _ in total.values()], pa.int64()), "sums": pa.array([s.astype("<i8").tobytes() for _, s in total.values()], pa.binary())})

    schema = "part int, n long, sums binary"
    tasks = docs.select("text").mapInArrow(tidy(count), schema)
    # Each part is added up as it streams in; what reaches the driver is the sketch, of fixed size.
    rows = tasks.repartition(PARTS, "part").mapInArrow(tidy(add), schema).collect()
    out, n = np.zeros((PARTS, WIDTH // PARTS), np.int64), 0
    for r in rows:
        out[r["part"]] += np.frombuffer(r["sums"], "<i8")
        n = max(n, r["n"])
    return out.reshape(-1), n


def damped_idf(sums: np.ndarray, n: int) -> np.ndarray:
    share = np.clip(sums / max(1, n), RARE, 1)
    return (1 + DAMP * np.log(1 / share) / np.log(1 / RARE)).astype(np.float32)


def weights_of(shingles: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[(shingles >> np.uint64(46)).astype(np.int64)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Sum of the lesser weights over the sum of the greater; 0 if neither has a shingle."""
    wa, wb = weights_of(*a, idf), weights_of(*b, idf)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[i], wb[j]).sum())
    high = float(wa.sum() + wb.sum()) - low
    return low / high if high else 0.0


# --- samples


class Sampler:
    """Improved consistent weighted sampling: for each of SAMPLES draws, the shingle with the least
    c / (y exp(r)), where y is the weight rounded down on a random exponential grid.

    r and c are gamma(2, 1), the grid's shift is uniform; all three are read from tables at a hash of
    the shingle and the draw.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, TABLE).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, TABLE)).astype(np.float32)
        self.shift = rng.random(TABLE, np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (unsigned 32-bit) of every text; starts: where each text's shingles begin, none of them empty."""
        out = np.empty((len(starts), len(self.odd)), np.uint32)
        log = np.log(weights).astype(np.float32)
        for k, odd in enumerate(self.odd):
            spread = shingles * odd
            at = (spread >> np.uint64(51)).astype(np.int32)
            r = self.r[at]
            t = np.floor(log * self.inverse[at] + self.shift[at])
            level = self.c[at] - r * (t + 1 - self.shift[at]) + np.float32(96)
            key = level.view(np.uint32).astype(np.uint64) << np.uint64(32)
            key |= (spread & np.uint64(0xFFFFFF00)) | (t.astype(np.int32) & 255).astype(np.uint64)
            out[:, k] = (np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, digest, samples array<int>) of every document; samples are empty where a text has no words."""

    def setup():
        sampler, known = Sampler(), {}

        def work(batch: pa.RecordBatch) -> dict:
            digests, texts = batch.column(2).to_pylist(), texts_of(batch)
            if len(known) > 20_000:
                known.clear()
            new = {d: t for d, t in zip(digests, texts, strict=True) if d not in known}
            sets = shingle_sets(list(new.values()))
            # Runs of texts with bounded numbers of shingles stay in the processor's cache.
            run: list[tuple[bytes, np.ndarray, np.ndarray]] = []
            size = 0
            for d, (s, c) in [*zip(new, sets, strict=True), (None, (None, None))]:
                if run and (d is None or size + len(s) > 1 << 15):
                    starts = np.cumsum([0, *(len(x) for _, x, _ in run[:-1])])
                    drawn = sampler.draw(np.concatenate([x for _, x, _ in run]), np.concatenate([w for _, _, w in run]), starts)
                    known.update((key, row) for (key, _, _), row in zip(run, drawn.view(np.int32), strict=True))
                    run, size = [], 0
                if d is None:
                    break
                if len(s):
                    run.append((d, s, weights_of(s, c, idf)))
                    size += len(s)
                else:
                    known[d] = np.zeros(0, np.int32)
            return {"doc_id": batch.column(0).cast(pa.int64()), "digest": batch.column(2), "samples": pa.array([known[d] for d in digests], pa.list_(pa.int32()))}

        return work

    rows = docs.select("doc_id", "text", digest_of().alias("digest"))
    return map_texts(rows, "doc_id long, digest binary, samples array<int>", None, columns=("doc_id", "text", "digest"), setup=setup)


# --- candidates


def equal_samples(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many samples each row of a shares with each row of b; 0 where a pair isn't likely similar."""
    same = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        same += a[:, k][:, None] == b[:, k][None, :]
    same[same < LIKELY * a.shape[1]] = 0
    return same


def nearest(same: np.ndarray) -> set[tuple[int, int]]:
    pairs: set[tuple[int, int]] = set()
    for _ in range(NEAREST):
        near = same.argmax(axis=1)
        pairs.update((i, j) for i, j in enumerate(near.tolist()) if same[i, j])
        same = same.copy()
        same[np.arange(len(same)), near] = 0
    return pairs


def block_links(samples: np.ndarray) -> tuple[set[tuple[int, int]], list[int], list[int]]:
    """Candidate pairs of a block, the most central member of each cluster, and the members without a pair.

    The pairs are the heaviest spanning forest (Prim's way) over likely similar members, and the
    nearest of every member.
    """
    n = len(samples)
    same = equal_samples(samples, samples)
    np.fill_diagonal(same, 0)
    pairs = {(min(p), max(p)) for p in nearest(same)}
    centre = same.sum(axis=1, dtype=np.int64)
    free, centres = centre > 0, []
    while free.any():
        root = int(np.flatnonzero(free)[0])
        cluster, best, source = [root], same[root].copy(), np.full(n, root)
        free[root] = False
        while True:
            reach = np.where(free, best, 0)
            j = int(reach.argmax())
            if not reach[j]:
                break
            free[j] = False
            cluster.append(j)
            pairs.add((min(j, int(source[j])), max(j, int(source[j]))))
            closer = same[j] > best
            best[closer], source[closer] = same[j][closer], j
        centres.append(max(cluster, key=lambda i: (centre[i], -i)))
    return pairs, centres, np.flatnonzero(centre == 0).tolist()


#: Kinds of rows that blocks give: a candidate pair, a cluster's centre, a member without a pair.
PAIR, CENTRE, ALONE = 0, 1, 2
_LEVEL = "a binary, b binary, bucket long, kind int"


def shared_buckets(texts: DataFrame) -> DataFrame:
    """(digest, bucket) of all buckets with two members or more."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("samples", i * ROWS + 1, ROWS)))
    members = texts.filter(F.size("samples") > 0).select("digest", F.explode(bands).alias("bucket"))
    return settle(members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "bucket").select("digest", "bucket"))


def candidates(texts: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(a, b) digests of distinct texts (digest, samples) to be verified, a < b.

    Centres of clusters meet again, level by level, until a bucket has one block; they halve each time
    at least. At every level, a member that has no pair in its block, where its bucket has several, is
    compared with all the others of the level, block by block.
    """
    members = shared_buckets(texts) if members is None else members
    found: list[DataFrame] = []
    while True:
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        # Blocks nest across buckets of any size: the leading bits of the digest's hash, as many as are
        # needed for half a block each, so members that share many bands meet in one block of each.
        sizes = sizes.select("bucket", F.ceil(F.log2(F.greatest(F.col("size") / (BLOCK // 2), F.lit(1.0)))).cast("int").alias("bits"))
        dealt = members.join(sizes, "bucket").withColumn("block", F.expr("CASE WHEN bits = 0 THEN 0L ELSE shiftrightunsigned(xxhash64(digest), 64 - bits) END"))
        blocks = dealt.join(texts, "digest").select("bucket", "block", "bits", "digest", "samples")
        level = settle(blocks.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "digest").mapInArrow(tidy(_in_blocks), _LEVEL))
        found.append(level.filter(F.col("kind") == PAIR).select("a", "b"))
        alone = level.filter(F.col("kind") == ALONE)
        if alone.take(1):
            found.append(settle(_against_all(alone.select(F.col("a").alias("digest"), "bucket"), dealt, sizes, texts)))
        members = level.filter(F.col("kind") == CENTRE).select(F.col("a").alias("digest"), "bucket")
        if not members.take(1):
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _level_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["a", "b", "bucket", "kind"])


def _groups(batches, width: int):
    """Runs of rows that are equal in the first `width` columns, over the ends of batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:width] != row[:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_blocks(batches):
    """Streams blocks in order. A block that hashing made larger than BLOCK is cut; its parts share a member."""
    out: list[tuple] = []
    for rows in _groups(batches, 2):
        bucket, _, bits = rows[0][:3]
        for at in range(0, max(1, len(rows) - 1), BLOCK):
            part = rows[at : at + BLOCK + 1]
            pairs, centres, alone = block_links(np.array([r[4] for r in part], np.int32))
            for i, j in pairs:
                out.append((*sorted((part[i][3], part[j][3])), bucket, PAIR))
            if bits:
                out += [(part[i][3], None, bucket, CENTRE) for i in centres]
                out += [(part[i][3], None, bucket, ALONE) for i in alone]
        if len(out) > 10_000:
            yield _level_batch(out)
            out = []
    if out:
        yield _level_batch(out)


def _against_all(alone: DataFrame, dealt: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of members without a pair in their block with the members of every block of their bucket."""
    asked = alone.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.col("bits")) - 1).cast("long")).cast("array<long>")).alias("block"), "digest", F.lit(1).alias("asks"))
    rows = dealt.join(alone.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "block", "digest", F.lit(0).alias("asks"))
    both = rows.union(asked).join(texts, "digest").select("bucket", "block", "asks", "digest", "samples")

    def run(batches):
        members: list[tuple] = []
        asking: list[tuple] = []

        def answer():
            mine = np.array([r[4] for r in members], np.int32)
            same = equal_samples(np.array([r[4] for r in asking], np.int32), mine)
            same[np.array([[q[3] == m[3] for m in members] for q in asking])] = 0
            pairs = {tuple(sorted((asking[i][3], members[j][3]))) for i, j in nearest(same)}
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

        key = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key or len(asking) >= BLOCK:
                    if asking and members:
                        yield answer()
                    asking = []
                if row[:2] != key:
                    key, members = row[:2], []
                (asking if row[2] else members).append(row)
        if asking and members:
            yield answer()

    return both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks").mapInArrow(tidy(run), "a binary, b binary")


# --- verification


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, digest, text) of the documents whose text may be wanted (wanted, rep_id); only these are shuffled."""
    source = docs.select("doc_id", digest_of().alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    return sifted(source, F.xxhash64("digest", "doc_id"), wanted, F.xxhash64("wanted", "rep_id"))[0]


def verified_links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, idf: np.ndarray, similar: float = SIMILAR) -> DataFrame:
    """(a, b, similarity) of the pairs whose whole texts are similar enough.

    Each text is fetched once, from the row that stands for its copies, and sent to its pairs.
    """
    ends = pairs.select(F.col("a").alias("digest"), "a", "b").union(pairs.select(F.col("b").alias("digest"), "a", "b"))
    wanted = settle(ends.join(reps.select("digest", "rep_id"), "digest").withColumnRenamed("digest", "wanted"))
    source = _texts_of(docs, wanted)
    texts = source.join(wanted, (F.col("digest") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("a", "b", "digest", "text")

    def compare(batches):
        held: list[tuple] = []

        def judge(groups):
            texts, keys = [], []
            for rows in groups:
                by = {r[2]: r[3] for r in rows}
                a, b = rows[0][:2]
                if a in by and b in by:
                    keys.append((a, b))
                    texts += [by[a], by[b]]
            sets = shingle_sets(texts)
            score = [weighted_jaccard(sets[2 * k], sets[2 * k + 1], idf) for k in range(len(keys))]
            kept = [(a, b, s) for (a, b), s in zip(keys, score, strict=True) if s >= similar]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.binary()), pa.array([k[1] for k in kept], pa.binary()), pa.array([k[2] for k in kept], pa.float64())], ["a", "b", "similarity"])

        groups, size = [], 0
        for batch in text_slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    groups.append(held)
                    held = []
                    if size > 1 << 21:
                        yield judge(groups)
                        groups, size = [], 0
                if not any(r[2] == row[2] for r in held):  # repeated rows bring a text again
                    held.append(row)
                    size += len(row[3])
        if held:
            groups.append(held)
        if groups:
            yield judge(groups)

    # Partitions by pair: a text that many pairs need goes to many tasks.
    return texts.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(tidy(compare), "a binary, b binary, similarity double")


# --- links that join what is left


def unjoined(texts: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, p, q, block, digest, label) of members that are likely similar to one of another label.

    p and q are the two blocks that meet. Members of the label that a bucket has most of need not meet
    one another, so only the others are sent to every block. A pair is looked at in the first band it
    shares.
    """
    labelled = members.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    counts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    one = F.col("size") <= BLOCK
    sizes = sizes.select("bucket", F.col("most.label").alias("main"), F.when(one, F.lit(1)).otherwise(F.ceil((F.col("size") - F.col("most.n")) / BLOCK)).alias("others"), F.when(one, F.lit(0)).otherwise(F.ceil(F.col("most.n") / BLOCK)).alias("mains"))
    dealt = labelled.join(sizes, "bucket").withColumn("is_main", (F.col("label") == F.col("main")) & (F.col("mains") > 0))
    deal = F.xxhash64("digest")
    dealt = dealt.withColumn("block", F.when(F.col("is_main"), F.col("others") + F.pmod(deal, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(deal, F.col("others"))))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")).cast("long") - 1)).alias("other")
    pairs = dealt.select("bucket", "digest", "label", F.col("block").cast("long").alias("block"), meets)
    pairs = pairs.select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "digest", "label").join(texts, "digest").select("bucket", "p", "q", "block", "digest", "label", "samples")

    def run(batches):
        out: list[tuple] = []
        for rows in _groups(batches, 3):
            far = _foreign(rows)
            if far.any():
                samples = np.array([r[6] for r in rows], np.int32)
                far &= equal_samples(samples, samples) > 0
                bands = samples.reshape(len(rows), BANDS, ROWS)
                mine = np.flatnonzero((bands == bands[:1]).all(axis=(0, 2)))
                for k in range(mine[0] if len(mine) else 0):
                    far &= ~(bands[:, None, k] == bands[None, :, k]).all(axis=2)
                out += [rows[i][:6] for i in np.flatnonzero(far.any(axis=1))]
            if len(out) > 10_000:
                yield _rows_batch(out)
                out = []
        if out:
            yield _rows_batch(out)

    def _rows_batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "p", "q", "block", "digest", "label"])

    return pairs.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(tidy(run), "bucket long, p long, q long, block long, digest binary, label binary")


def _foreign(rows: list[tuple]) -> np.ndarray:
    """Which pairs of rows (bucket, p, q, block, digest, label, ..) are to be compared: of other labels, and of both blocks if two meet."""
    label = np.unique([r[5].hex() for r in rows], return_inverse=True)[1]
    far = label[:, None] != label[None, :]
    if rows[0][1] != rows[0][2]:
        block = np.array([r[3] for r in rows])
        far &= block[:, None] != block[None, :]
    return far


def all_similarities(sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs, to single precision: a shingle that occurs k times is k features."""
    n = len(sets)
    keys = np.concatenate([np.repeat(s, c) for s, c in sets])
    turn = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for _, c in sets])
    row = np.repeat(np.arange(n), [int(c.sum()) for _, c in sets])
    weight = idf[(keys >> np.uint64(46)).astype(np.int64)]
    total = np.bincount(row, weights=weight, minlength=n)
    _, column, often = np.unique(keys ^ np.where(turn > 0, mix(turn.astype(np.uint64)), np.uint64(0)), return_inverse=True, return_counts=True)
    shared = often > 1
    row, weight, column = row[shared[column]], weight[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, weight, column = row[order], np.sqrt(weight[order]), column[order]
    low, width = np.zeros((n, n), np.float64), max(1, (1 << 22) // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, min(width, int(column[-1]) + 1 - at)), np.float32)
        part[row[a:b], column[a:b] - at] = weight[a:b]
        low += part @ part.T
    high = total[:, None] + total[None, :] - low
    return np.divide(low, high, out=np.zeros_like(low), where=high > 0)


def joins_of(rows: list[tuple], sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, similar: float) -> list[tuple]:
    """(a, b, similarity, label of a, label of b) of links that join the labels of rows, as far as links can."""
    score = np.where(np.triu(_foreign(rows)), all_similarities(sets, idf), 0)
    first, second = np.nonzero(score >= similar - 1e-3)
    root = {r[5]: r[5] for r in rows}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for k in np.argsort(-score[first, second], kind="stable"):
        i, j = int(first[k]), int(second[k])
        a, b = top(rows[i][5]), top(rows[j][5])
        if a != b and (s := weighted_jaccard(sets[i], sets[j], idf)) >= similar:
            root[a] = b
            (a, la), (b, lb) = sorted(((rows[i][4], rows[i][5]), (rows[j][4], rows[j][5])))
            out.append((a, b, s, la, lb))
    return out


def joining_links(left: DataFrame, docs: DataFrame, reps: DataFrame, idf: np.ndarray, similar: float = SIMILAR) -> DataFrame:
    """(a, b, similarity, la, lb): links between texts of different labels among the rows of unjoined()."""
    wanted = settle(left.join(reps.select("digest", "rep_id"), "digest").withColumnRenamed("digest", "wanted"))
    source = _texts_of(docs, wanted)
    texts = source.join(wanted, (F.col("digest") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("bucket", "p", "q", "block", "digest", "label", "text")

    def compare(batches):
        for rows in _groups(text_slices(batches), 3):
            rows = list({r[4]: r for r in rows}.values())  # repeated rows bring a text again
            found = joins_of(rows, shingle_sets([r[6] for r in rows]), idf, similar)
            if found:
                kinds = (pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], ["a", "b", "similarity", "la", "lb"])

    joined = texts.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(tidy(compare), "a binary, b binary, similarity double, la binary, lb binary")
    return joined.dropDuplicates(["a", "b"])


def joined_labels(labels: DataFrame, joins: DataFrame) -> DataFrame:
    """labels after joins (la, lb) between them; a text without a label is its own."""
    roots = connected_components(joins.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    moved = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return moved.union(roots.join(labels, "node", "left_anti").select("node", "label"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, digest, class_id, class_size, copies, n_links, kept) of every document.

    class_id: the least id of the class; copies: rows with this very text; n_links: verified links of
    the text to other texts, not those of pairs whose ends others had joined before they were verified; kept: the document that stays of its class.
    """
    idf = damped_idf(*frequencies(docs))
    rows = settle(signatures(docs, idf))
    texts = settle(rows.groupBy("digest").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first("samples").alias("samples")))
    signed = texts.select("digest", "samples")
    members = shared_buckets(signed)
    links = settle(verified_links(settle(candidates(signed, members)), docs, texts, idf, similar))
    labels = connected_components(links)
    left = settle(unjoined(signed, members, labels))
    if left.take(1):
        joins = settle(joining_links(left, docs, texts, idf, similar))
        labels = settle(joined_labels(labels, joins))
        links = links.union(joins.select("a", "b", "similarity"))
    degree = links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_links"))
    linked = texts.select("digest", "rep_id", "copies").join(labels.withColumnRenamed("node", "digest"), "digest", "left").join(degree, "digest", "left")
    linked = linked.withColumn("label", F.coalesce("label", "digest"))
    sizes = linked.groupBy("label").agg(F.min("rep_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct("rep_id", "digest")).getField("digest").alias("kept_digest"))
    classes = linked.join(sizes, "label").select("digest", "class_id", "class_size", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "rep_id", (F.col("digest") == F.col("kept_digest")).alias("first"))
    out = rows.select("doc_id", "digest").join(classes, "digest")
    return out.select("doc_id", "digest", "class_id", "class_size", "copies", "n_links", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep_id"))).alias("kept"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with one document of each class: the one of the least id (of repeated rows, one)."""
    kept = near_duplicates(docs, similar).filter("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    kept = settle(kept.select(F.col("doc_id").alias("id"), F.col("digest").alias("chosen"), "n"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", digest_of().alias("digest"))
    out = keyed.join(kept, (keyed.digest == kept.chosen) & keyed.doc_id.eqNullSafe(kept.id), "left_semi")
    if kept.filter("n > 1").take(1):  # repeated rows: only then is a row dropped here
        out = out.dropDuplicates(["doc_id", "digest"])
    return out.select("row.*")
