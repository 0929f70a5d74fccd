"""Packing, token counts and byte-level BPE."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomtable.llm import bpe, counts, packing, queries

RANKS, MULTI, PATTERN = public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.path(queries.BYTE_BPE_MULTI), public_tokenizers.PATTERN
PARTS = ["a", "é", " ", "  ", "\n", "\t", "'s", " 's", "12", "²", "ß", "中文", "!!", "$", "foo", "bar.", " x", "\x1c", "ʼ", "Ω", "🙂", "'ll", "a b c "]


@pytest.mark.parametrize("path", [RANKS, MULTI])
def test_chunks_encode_as_the_whole(path):
    code, rng = bpe.codec(path, PATTERN), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 120)))
        want = code.encoding.encode_ordinary(text)
        assert code.encode(text).tolist() == want
        for chunk, overlap in ((20, 8), (64, 10)):
            pieces = list(code.pieces(text, chunk, overlap))
            assert "".join(pieces) == text
            assert sum((code.encoding.encode_ordinary(p) for p in pieces), []) == want
        assert code.decode(want) == text.encode()


def test_a_run_longer_than_chunks():
    code = bpe.codec(RANKS, PATTERN)
    text = "x" * 500 + " " * 300 + "y"
    assert sum((code.encoding.encode_ordinary(p) for p in code.pieces(text, 50, 10)), []) == code.encoding.encode_ordinary(text)


def test_a_long_run_is_read_a_few_times():
    code, seen = bpe.codec(RANKS, PATTERN), []
    real = code.boundaries
    code.boundaries = lambda chunk: seen.append(len(chunk)) or real(chunk)
    try:
        pieces = list(code.pieces("x" * 1_000_000 + " end", 1000, 100))
    finally:
        del code.boundaries
    assert "".join(pieces) == "x" * 1_000_000 + " end" and sum(seen) < 6_000_000


def test_characters_of_another_unicode_version():
    code, rng = bpe.codec(MULTI, PATTERN), random.Random(2)
    odd = [*map(chr, rng.sample(sorted(bpe.stand_ins(PATTERN)), min(400, len(bpe.stand_ins(PATTERN))))), " ", "a", "1", "!", "\n"]
    for _ in range(200):
        text = "".join(rng.choices(odd, k=150))
        pieces = list(code.pieces(text, 20, 12))
        assert "".join(pieces) == text
        assert sum((code.encoding.encode_ordinary(p) for p in pieces), []) == code.encoding.encode_ordinary(text)


def test_most_documents_have_several_chunks(spark):
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    code = bpe.codec(MULTI, PATTERN)
    assert sum(len(list(code.pieces(t))) > 1 for t in texts) > len(texts) / 2
    assert all(code.encode(t).tolist() == code.encoding.encode_ordinary(t) for t in texts)


def test_rank_file_gives_the_tokenizer_files_ids(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    code = bpe.codec(RANKS, PATTERN)
    for _, text, *_ in rows:
        assert plain.encode(text or "", add_special_tokens=False).ids == code.encode(text or "").tolist()


def test_encoded_digests(docs, rows, empty):
    code = bpe.codec(MULTI, PATTERN).encoding
    want = sorted((r[0] if r[0] is not None else -1, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((r[1] or "").encode()).hexdigest()) for r in rows for ids in [code.encode_ordinary(r[1] or "")])
    got = bpe.encoded_digests(docs, MULTI, PATTERN).collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == want
    both = bpe.encode_documents(docs, MULTI, PATTERN).collect()
    assert all(r["decoded"] == b"".join(code.decode_single_token_bytes(i) for i in r["ids"]) for r in both)
    assert bpe.encoded_digests(empty, MULTI, PATTERN).count() == 0


def ids_of(text):
    return [*bpe.codec(RANKS, PATTERN).encoding.encode_ordinary(text or ""), 0]


def check_packing(got, rows, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array(ids_of(text), "<u4")
        starts = packing.cut_starts(len(ids), capacity)
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, want)) == sorted(key(tuple(r)[:5]) for r in got)
    return len(by_sequence), -(-sum(w[3] for w in want) // capacity)


@pytest.mark.parametrize("capacity", [2048, 256])
def test_packing(docs, rows, empty, capacity):
    used, least = check_packing(packing.pack_documents(docs, RANKS, PATTERN, capacity).collect(), rows, capacity)
    assert used <= least * 1.1 + 1
    assert packing.pack_documents(empty, RANKS, PATTERN, capacity).count() == 0


def test_added_tokens_get_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.BYTE_BPE_FILE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext| >", " <|endoftext|>'s"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack_documents(frame, RANKS, PATTERN, added=packing.added_tokens(path)).collect()
    plain = Tokenizer.from_file(path)
    want = {k: np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in enumerate(texts)}
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {k: (len(v), zlib.crc32(v.tobytes())) for k, v in want.items()}


def test_cuts():
    assert packing.cut_starts(5, 8) == [0] and packing.cut_starts(8, 8) == [0] and packing.cut_starts(16, 8) == [0, 8] and packing.cut_starts(19, 8) == [0, 3, 11]


@pytest.mark.parametrize("seed", range(6))
def test_plans_cover_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 512])
    histogram = {rng.randint(1, capacity): rng.randint(1, 400) for _ in range(rng.randint(1, 60))}
    plan = packing.plan_packing(histogram, capacity, groups=rng.choice([1, 5, 40]))
    fill, ranks = defaultdict(list), defaultdict(set)
    for length, rank, n, first, each, offset in plan.runs:
        for k in range(n):
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
            fill[first + k // each].append((offset + k % each * length, length))
    assert {n: set(range(c)) for n, c in histogram.items()} == dict(ranks)
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(fill) == plan.sequences
    assert plan.sequences <= 1.15 * -(-sum(n * c for n, c in histogram.items()) // capacity) + 60 or max(histogram) > capacity // 2


def test_edits_count_as_encoding_anew():
    code, rng = bpe.codec(RANKS, PATTERN), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 120)))
        tree = counts.CountedText(text, code, size=rng.choice([4, 16, 40]))
        for _ in range(5):
            a = rng.randint(0, len(text) + 3)
            b, new = a + rng.choice([0, 0, 1, 5, 30]), "".join(rng.choices(PARTS, k=rng.randint(0, 8)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[max(min(a, len(text)), min(b, len(text))) :]
            assert tree.text() == text and tree.tokens == len(code.encoding.encode_ordinary(text))


def test_long_texts_are_encoded_in_part_only():
    code = bpe.codec(RANKS, PATTERN)
    tree = counts.CountedText("some words in a row " * 5000, code)
    tree.edit(40_000, 40_005, "other words")
    assert tree.reencoded < 2000


def test_counts_with_a_table_of_edits(spark, docs, rows, empty):
    code = bpe.codec(RANKS, PATTERN).encoding
    got = counts.count_with_edits(counts.sample_edits(docs), RANKS, PATTERN).collect()
    want = []
    for doc_id, text, *_ in rows:
        old = text or ""
        n = len(old)
        new = old[: n // 3] + " inserted words," + old[n // 3 :]
        new = new[: n // 2] + "replaced" + new[n // 2 + 9 :]
        a = max(0, n - 5)
        new = new[:a] + new[max(a, n + 30) :]
        want.append((-1 if doc_id is None else doc_id, len(code.encode_ordinary(old)), len(code.encode_ordinary(new))))
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in got) == sorted(want)
    edits = spark.createDataFrame([(1, 1, 0, 3, "Zed"), (1, 0, 0, 0, "one two "), (2, 0, 1, 2, None)], "doc_id long, seq int, start long, stop long, replacement string")
    some = counts.attach_edits(docs.filter("doc_id in (0, 1, 2)"), edits)
    told = {r["doc_id"]: r for r in counts.count_with_edits(some, RANKS, PATTERN).collect()}
    texts = {r[0]: r[1] for r in rows[:3]}
    new = "one two " + texts[1]
    assert told[1]["n_tokens_edited"] == len(code.encode_ordinary("Zed" + new[3:])) and told[0]["n_edits"] == 0
    assert told[2]["n_tokens_edited"] == len(code.encode_ordinary(texts[2][0] + texts[2][2:]))
    assert counts.count_with_edits(counts.sample_edits(empty), RANKS, PATTERN).count() == 0


def test_stored_trees_take_further_edits(spark):
    code = bpe.codec(RANKS, PATTERN)
    text = "some words, and more of them " * 400
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string")
    trees = counts.tree_table(docs, RANKS, PATTERN)
    for start, stop, new in ((5000, 5010, "changed"), (0, 0, "first "), (20, 9000, None)):
        one = F.array(F.struct(F.lit(start).cast("long").alias("start"), F.lit(stop).cast("long").alias("stop"), F.lit(new).cast("string").alias("replacement")))
        after = counts.edit_trees(trees.withColumn("edits", one), RANKS, PATTERN)
        text = text[:start] + (new or "") + text[stop:]
        got = after.collect()
        ones = [r for r in got if r["doc_id"] == 1]
        assert len(got) == 4 and all(r["text"] == text and r["n_tokens_edited"] == len(code.encode(text)) == sum(r["leaf_tokens"]) for r in ones)
        assert all(r["n_chars_reencoded"] < 2500 for r in ones)  # of more than 2,600: only what the edit touches
        trees = spark.createDataFrame([(r["doc_id"], r["text"], r["leaf_chars"], r["leaf_tokens"]) for r in got], counts.TREES)


def test_packing_is_as_good_as_best_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = np.minimum(np.exp(rng.normal(5.8, 1.1, 20_000)).astype(int) + 1, 2048)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plain = packing.plan_packing(histogram, 2048, small_share=1)  # nothing counts as large: best fit alone
    ours = packing.plan_packing(histogram, 2048)
    least = -(-sum(k * n for k, n in histogram.items()) // 2048)
    assert least <= ours.sequences <= plain.sequences
