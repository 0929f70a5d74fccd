"""Near duplicates, repeated strings and the pipeline, against brute force."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from loomtable.llm import components, neardup, packing, quality, queries, repeats, rules
from loomtable.llm.shingles import shingle_sets

from .conftest import SCHEMA, edited, prose
from .test_quality_rules_language import brute_rules
from .test_tokens import check_packing

# --- shingles and samples


def test_shingles():
    sets = shingle_sets(["a b c d e f", "A b\nc d e", "a b c", "a b c d", "", " \n", "e d c b a", "w" * 100 + " b c d e", "a b c d e a b c d e"])
    assert [len(s) for s, _ in sets] == [2, 1, 1, 1, 0, 0, 1, 1, 5]
    assert sets[1][0][0] in sets[0][0] and len({s[0] for s, _ in sets if len(s)}) >= 5
    assert sets[8][1].max() == 2 and sets[1][0][0] in sets[8][0]
    assert sets[2][0][0] != sets[3][0][0]


def weights(text, idf):
    s, c = shingle_sets([text])[0]
    return dict(zip(s.tolist(), neardup.weights_of(s, c, idf).tolist(), strict=True))


def brute_similarity(a, b, idf):
    wa, wb = weights(a, idf), weights(b, idf)
    keys = wa.keys() | wb.keys()
    high = sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
    return sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / high if high else 0.0


def test_samples_estimate_weighted_jaccard():
    rng, idf = random.Random(1), neardup.damped_idf(np.zeros(neardup.WIDTH, np.int64), 10)
    sampler = neardup.Sampler()
    gap = []
    for k in range(60):
        a = prose(rng, 200)
        b = edited(rng, a, 0.02 * (k % 4))
        (sa, ca), (sb, cb) = shingle_sets([a, b])
        both = sampler.draw(np.concatenate([sa, sb]), np.concatenate([neardup.weights_of(sa, ca, idf), neardup.weights_of(sb, cb, idf)]), np.array([0, len(sa)]))
        exact = neardup.weighted_jaccard((sa, ca), (sb, cb), idf)
        assert abs(exact - brute_similarity(a, b, idf)) < 1e-5
        gap.append((both[0] == both[1]).mean() - exact)
    assert abs(np.mean(gap)) < 0.03 and np.std(gap) < 0.1


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(61, 200)) for _ in range(90)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    label = {n: n for pair in links for n in pair}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["label"] for r in components.connected_components(frame).collect()} == label
    assert components.connected_components(frame.limit(0)).count() == 0


def classes_of(texts, idf):
    """Classes of texts (None is empty) by brute force over all pairs."""
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or brute_similarity(texts[i] or "", texts[j] or "", idf) >= 0.8:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def test_near_duplicates(docs, rows, empty):
    idf = neardup.damped_idf(*neardup.frequencies(docs))
    texts = [r[1] for r in rows]
    want = classes_of(texts, idf)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    ids = defaultdict(set)
    for r, c in zip(rows, want, strict=True):
        ids[c].add(r[0])
    expected = Counter((frozenset(ids[c])) for c in want)
    mine = defaultdict(list)
    for r in got:
        mine[(r["class_id"], r["class_size"])].append(r["doc_id"])
    assert Counter(frozenset(v) for v in mine.values() for _ in v) == expected
    assert all(size == len(v) for (_, size), v in mine.items())
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(want))
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_crowded_buckets(spark, monkeypatch):
    """Many near copies of two texts, and unrelated members of one bucket, in blocks of a few."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(8)
    a, b = prose(rng, 200), prose(rng, 200)
    texts = [edited(rng, a, 0.004) for _ in range(60)] + [edited(rng, b, 0.004) for _ in range(30)] + [prose(rng, 50) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame).collect()}
    want = classes_of(texts, neardup.damped_idf(*neardup.frequencies(frame)))
    assert [got[i] for i in range(len(texts))] == [min(j for j in range(len(texts)) if want[j] == want[i]) for i in range(len(texts))]


def test_members_without_a_neighbour_meet_all_others(spark, monkeypatch):
    """One bucket of strangers with a single pair that blocks part: the pair is found."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 1 << 30, (40, neardup.SAMPLES)).astype(np.int32)
    samples[:, :4] = 5
    samples[39] = samples[0]
    samples[39, 40:] = 1
    frame = spark.createDataFrame([(bytearray(sha256(bytes([k])).digest()[:16]), row.tolist()) for k, row in enumerate(samples)], "digest binary, samples array<int>")
    pairs = {(bytes(r["a"]), bytes(r["b"])) for r in neardup.candidates(frame).collect()}
    assert pairs == {tuple(sorted((sha256(bytes([0])).digest()[:16], sha256(bytes([39])).digest()[:16])))}


def replaced(rng, text, count):
    """text with `count` words replaced."""
    words = text.split()
    for k in rng.sample(range(len(words)), count):
        words[k] = "y" + str(rng.randint(0, 9999))
    return " ".join(words)


def wrongly_classed(spark, texts):
    """How many texts have another class than by brute force over all pairs."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame).collect()}
    want = classes_of(texts, neardup.damped_idf(*neardup.frequencies(frame)))
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    return sum(got[i] != least[c] for i, c in enumerate(want))


def test_a_hub_and_copies_similar_only_to_it(spark, monkeypatch):
    """Independently edited copies in many blocks, joined by their original alone."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(31)
    original = " ".join(prose(rng, 300).split())
    assert wrongly_classed(spark, [original] + [replaced(rng, original, 6) for _ in range(250)]) == 0


def test_edited_copies_without_their_original(spark):
    """Copies near the threshold in a single block: every pair at 0.8 joins its texts."""
    rng = random.Random(41)
    original = " ".join(prose(rng, 300).split())
    assert wrongly_classed(spark, [replaced(rng, original, 4) for _ in range(100)]) == 0


def test_similarities_of_all_pairs(rows):
    idf = neardup.damped_idf(np.arange(neardup.WIDTH, dtype=np.int64), neardup.WIDTH)
    sets = [s for s in shingle_sets([r[1] or "" for r in rows]) if len(s[0])]
    got = neardup.all_similarities(sets, idf)
    for i in range(0, len(sets), 3):
        for j in range(i):
            assert abs(got[i, j] - neardup.weighted_jaccard(sets[i], sets[j], idf)) < 1e-4


def test_centres_without_a_partner_in_their_block(spark, monkeypatch):
    """Families of one bucket, two texts in each of two blocks that do not nest: their centres meet."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    free = defaultdict(list)
    for k in range(400):
        digest = sha256(bytes([k % 256, k // 256])).digest()[:16]
        free[xxhash.xxh64_intdigest(digest, seed=42) >> 62].append(digest)
    rows, family = [], {}
    for k in range(8):
        base = rng.integers(0, 1 << 30, neardup.SAMPLES)
        base[:4] = 5
        for block in (0, 0, 3, 3) if k % 2 else (1, 1, 2, 2):
            mine = base.copy()
            mine[7::4] = rng.integers(0, 1 << 30, neardup.BANDS - 1)  # no second band is shared
            digest = free[block].pop()
            rows.append((bytearray(digest), mine.tolist()))
            family[digest] = k
    frame = spark.createDataFrame(rows, "digest binary, samples array<int>")
    pairs = neardup.candidates(frame)
    assert all(family[bytes(r["a"])] == family[bytes(r["b"])] for r in pairs.collect())
    label = {bytes(r["node"]): bytes(r["label"]) for r in components.connected_components(pairs).collect()}
    assert len(label) == 32 and len(set(label.values())) == 8


# --- repeated strings


def brute_repeats(texts, length):
    """Kept bytes and removed runs of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int8)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
        out.append((bytes(b for b, g in zip(r, gone, strict=False) if not g), int(gone.sum()), len(edges) // 2))
    return out


@pytest.mark.parametrize("length", [3, 8, 20])
def test_expansion_equals_counting(length):
    rng = random.Random(length)
    for _ in range(60):
        pool = [bytes(rng.choices(b"abc", k=rng.randint(1, 40))) for _ in range(4)]
        texts = [b"".join(rng.choices(pool, k=rng.randint(0, 5))) for _ in range(rng.randint(1, 6))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, got in zip(texts, repeats.repeated_windows(texts, length), strict=True):
            assert got.tolist() == [seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)]


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(5)
    for sizes in ([0, 399, 400, 401, 3000], [5000], [10, 20]):
        raw = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
        offsets = np.cumsum([0, *sizes])
        for gram in repeats.ladder(400):
            anchors, starts, n = repeats.anchor_runs(raw, offsets, gram)
            found = sorted(p for a, k in zip(starts.tolist(), n.tolist(), strict=True) for p in range(a, a + k))
            assert found == [p for a, b in zip(offsets[:-1], offsets[1:], strict=True) for p in range(a, b - 399)]
            assert len(anchors) == len(starts)


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats(docs, rows, empty, hot):
    want = brute_repeats([r[1] for r in rows], 400)
    got = repeats.removed_digests(docs, hot=hot).collect()
    told = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert told == sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), n, k, sha256(kept).hexdigest()) for r, (kept, n, k) in zip(rows, want, strict=True))
    if hot == 1:
        return
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns and cut.schema == docs.schema
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in cut.collect())
    assert texts == sorted((str(r[0]), kept.decode("utf-8", "ignore")) for r, (kept, _, _) in zip(rows, want, strict=True))
    assert sum(r["text"] is None for r in cut.collect()) == 2
    assert repeats.removed_digests(empty).count() == 0 and repeats.without_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats_and_shorter_passages(docs, rows, empty, hot):
    """Removal is that of 400 bytes; beside it, what strings of 240 bytes cover."""
    want, short = (brute_repeats([r[1] for r in rows], n) for n in (400, 240))
    told = [tuple(r) for r in repeats.removed_digests(docs, hot=hot, passage=240).collect()]
    plain = [(r[0], len((r[1] or "").encode()), n, k, sha256(kept).hexdigest(), m) for r, (kept, n, k), (_, m, _) in zip(rows, want, short, strict=True)]
    assert sorted(map(str, told)) == sorted(map(str, plain)) and any(r[5] > r[2] for r in told)
    assert repeats.removed_digests(empty, hot=hot, passage=240).count() == 0
    with pytest.raises(ValueError):
        repeats.removed_digests(docs, passage=401)


def test_query_tells_of_passages_of_over_50_words(spark, tmp_path):
    """A passage of 51 words that two documents share is too short to be removed, and is told of."""
    rng = random.Random(9)
    part = " ".join(f"w{k:04d}" for k in range(51))
    texts = [prose(rng, 80) + "\n" + part + "\n" + prose(rng, 80), "É" + part, prose(rng, 200), part[: corpus_pipeline.PASSAGE - 1], None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op10_repeats(spark, str(tmp_path)).collect()}
    assert queries.PASSAGE == corpus_pipeline.PASSAGE and corpus_pipeline.PASSAGE <= len(part) < 400
    for i, (kept, n, k) in enumerate(brute_repeats(texts, 400)):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (n, k, sha256(kept).hexdigest()) and n == 0
    assert [got[i]["n_passage_bytes"] for i in range(5)] == [len(part), len(part), 0, 0, 0]


def test_long_texts_in_chunks(monkeypatch, spark):
    monkeypatch.setattr(repeats, "CUT", 1 << 11)
    rng = random.Random(6)
    part = prose(rng, 400)
    texts = [prose(rng, 1500) + part + prose(rng, 1500), prose(rng, 20) + part, part[100:] + prose(rng, 9)]
    chunked = [list(repeats._chunks(*a, 400, 4096)) for a in [(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts]]
    assert len(chunked[0]) > 1 and all(len(c[0]) <= 4096 + 399 for c in chunked[0])
    got = {r["doc_id"]: r for r in repeats.removed_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (kept, n, _) in enumerate(brute_repeats(texts, 400)):
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (n, sha256(kept).hexdigest())


# --- the pipeline


def test_pipeline_stage_by_stage(spark, docs, rows, tmp_path):
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(45)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table, sf = docs, str(tmp_path)
    results = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, sf).write.parquet(str(tmp_path / f"stage{k}"))
        before, table = table, spark.read.parquet(str(tmp_path / f"stage{k}"))
        results[name] = (before.collect(), table.collect())
        if name != "packing":
            assert table.columns == docs.columns
    before, after = results["quality"]
    field = quality.train(*quality.columns(quality.training_rows(docs, spark.read.parquet(sf + "/labels.parquet"))))
    score = {r[0]: field.score(np.frombuffer(r[0].encode(), np.uint8), np.array([0, len(r[0].encode())]))[0] for r in ((x["text"] or "",) for x in before)}
    assert Counter(map(str, after)) == Counter(str(r) for r in before if score[r["text"] or ""] >= 0.3)
    before, after = results["rules"]
    assert Counter(map(str, after)) == Counter(str(r) for r in before if brute_rules(r["text"])[-1])
    before, after = results["near_duplicates"]
    texts = [r["text"] for r in before]
    frame = spark.createDataFrame([tuple(r) for r in before], SCHEMA)
    want = classes_of(texts, neardup.damped_idf(*neardup.frequencies(frame)))
    label = {t: c for t, c in zip(texts, want, strict=True)}
    assert sorted(label[r["text"]] for r in after) == sorted(set(want))
    before, after = results["repeats"]
    cut = brute_repeats([r["text"] for r in before], 400)
    assert sorted(r["text"] for r in after) == sorted(k.decode("utf-8", "ignore") for k, _, _ in cut)
    assert all(r["n_chars"] in (None, len(r["text"])) for r in after)
    before, after = results["packing"]
    check_packing(after, [tuple(r) for r in before], 2048)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"] or -1, r["piece"], r["length"]) for r in whole.collect()) == sorted((r["doc_id"] or -1, r["piece"], r["length"]) for r in after)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "rules", "near_duplicates", "repeats", "packing"]
    assert packing.cut_starts(1, 2048) == [0] and rules.DEFAULT.version == 1
