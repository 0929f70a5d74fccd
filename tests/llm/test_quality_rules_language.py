"""The line field, the rule ledger and language models."""

import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from loomtable.llm import langid, quality, rules

from .conftest import prose


def as_bytes(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


# --- quality


def brute_marginals(score, turn):
    n, total, node = len(score), 0.0, np.zeros((len(score), 2))
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(score[k][s] for k, s in enumerate(path)) + sum(turn[a][b] for a, b in itertools.pairwise(path)))
        total += w
        for k, s in enumerate(path):
            node[k, s] += w
    return node / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 7, 1, 2]
    first = np.cumsum([0, *sizes])
    score, turn = rng.normal(size=(first[-1], 2)) * 3, rng.normal(size=(2, 2)) * 2
    node, pair = quality.forward_backward(score, turn, first)
    for a, b in itertools.pairwise(first):
        assert np.allclose(node[a:b], brute_marginals(score[a:b], turn))
    inner = np.ones(len(score), bool)
    inner[first[:-1]] = False
    assert np.allclose(pair[inner].sum(axis=1), node[inner]) and np.allclose(pair[inner].sum(axis=2), node[np.flatnonzero(inner) - 1])


def test_lines_and_features():
    raw, offsets = as_bytes(["", "one\n\ntwo two two", "\n", "A"])
    starts, ends, first = quality.split_lines(raw, offsets)
    text = raw.tobytes()
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == [b"", b"one", b"", b"two two two", b"", b"", b"A"]
    assert first.tolist() == [0, 1, 4, 6, 7]
    assert quality.word_repeats(raw, starts, ends).tolist() == [0, 0, 0, 2, 0, 0, 0]
    x = quality.line_features(raw, starts, ends)
    assert np.isfinite(x).all() and x[6, 0] == 1 and x[3, 1] == 9 / 11
    assert len(quality.line_features(raw[:0], np.zeros(1, np.int64), np.zeros(1, np.int64))) == 1


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text = prose(rng, rng.randint(20, 200))
        if k % 3 == 0:
            text = "\n".join(" ".join(w + "$$$" for w in line.split()) for line in text.split("\n")) if k % 2 else text.upper()
        out.append((text, int(k % 3 != 0)))
    return out


def test_it_learns(spark, docs, rows, empty):
    train, held = labelled(200, 1), labelled(90, 2)
    field = quality.train(*quality.columns(train))
    right = (field.score(*as_bytes([t for t, _ in held])) >= 0.3) == np.array([y == 1 for _, y in held])
    assert right.mean() > 0.95
    got = quality.score_documents(docs, field).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    alone = {r["doc_id"]: r["score"] for r in got}
    for doc_id, text, *_ in rows[:-2]:
        assert abs(alone[doc_id] - field.score(*as_bytes([text or ""]))[0]) < 1e-9
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.score_documents(empty, field).count() == 0 and quality.keep_good(empty, field).count() == 0


def test_training_rows_leave_the_held_out_fold(spark, empty):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, None)], "doc_id long, quality int")
    got = quality.training_rows(docs, labels, sample=10_000)
    want = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 0]
    assert sorted(t for t, _ in got if t) == sorted(f"text {i}" for i in want)
    assert all(y == int(t.split()[1]) % 2 for t, y in got if t)
    assert len(quality.training_rows(docs, labels, sample=20)) < 60
    nothing = quality.training_rows(empty, labels.limit(0))
    assert nothing == [] and quality.train([], []).score(*as_bytes(["x", ""])).min() > 0.3
    assert quality.train(["a b", "c"], [0, 0]).score(*as_bytes(["x"]))[0] < 0.3


# --- rules


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    n, chars, symbols, dup = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    if again is None:
        from collections import Counter

        c = Counter(windows)
        again = {i + k for i, w in enumerate(windows) if c[w] > 1 for k in range(3)}
    base = n < 50 or 100 * len(again) > 50 * n
    kept = not base and not (10 * symbols > 4 * n or 10 * dup > 5 * len(lines) or chars < 2 * n or chars > 14 * n)
    failed = (n < 50, 100 * len(again) > 50 * n, 10 * symbols > 4 * n, 10 * dup > 5 * len(lines), chars < 2 * n, chars > 14 * n, n < 100)
    return (n, chars, symbols, dup, len(again), base, kept, sum(f << k for k, f in enumerate(failed)), "default/1")


def test_rules(docs, rows, empty):
    got = rules.apply_policy(rules.ledger(docs)).select(*rules.COLUMNS).collect()
    assert sorted(map(repr, (tuple(r)[1:] for r in got))) == sorted(map(repr, (brute_rules(r[1]) for r in rows)))
    by = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert all(by[r[0]] == brute_rules(r[1]) for r in rows[:-2])
    assert rules.ledger(empty).count() == 0
    kept = rules.keep_passing(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, (r for r in docs.collect() if brute_rules(r["text"])[6])))


def test_rules_in_sql(docs, rows):
    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by the view
    con.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM frame")
    sql = con.sql(rules.ORACLE)
    assert sql.columns == list(rules.COLUMNS)
    want = sql.fetchall()
    assert sorted(map(repr, (tuple(r[1:]) for r in want))) == sorted(map(repr, (brute_rules(r[1]) for r in rows)))


def test_ablations(docs):
    book = rules.ledger(docs)
    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by the view
    con.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM frame")
    sql = con.sql(rules.ABLATIONS_ORACLE)
    found = rules.ablations(book)
    assert sql.columns == found.columns and sorted(sql.fetchall()) == sorted(map(tuple, found.collect()))
    bits = [r["fail_bits"] for r in book.select("fail_bits").collect()]
    mask = rules.DEFAULT.mask
    for r in rules.ablations(book).collect():
        bit = next(1 << x.bit for x in rules.RULES if x.name == r["rule"])
        assert r["failed"] == sum(bool(b & bit) for b in bits)
        assert r["failed_alone"] == sum(b & mask == bit for b in bits)
        assert r["kept_without"] == sum(b & mask & ~bit == 0 for b in bits)
    assert rules.STRICT.mask == rules.DEFAULT.mask | 64
    plan = rules.apply_policy(book)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- languages


def brute_bits(tree, text):
    cost = 0.0
    for i, symbol in enumerate(text):
        past = (b"\0" * langid.ORDER + text)[i : i + langid.ORDER]
        for order in range(langid.ORDER, -1, -1):
            context = int.from_bytes(past[langid.ORDER - order :], "big")
            gram = context << 8 | symbol
            known = dict(zip(tree.contexts[order].tolist(), zip(tree.totals[order].tolist(), tree.distinct[order].tolist(), strict=True), strict=True))
            seen = dict(zip(tree.seen[order].tolist(), tree.counts[order].tolist(), strict=True))
            if context not in known:
                continue
            n, d = known[context]
            if gram in seen:
                cost += np.log2((n + d) / seen[gram])
                break
            cost += np.log2((n + d) / d)
        else:
            cost += 8
    return cost


def test_code_lengths():
    rows = [("en", "the theory of this and that"), ("fr", "le théâtre de la théorie"), ("en", "other"), ("fr", "")]
    model = langid.LanguageModel.learn(rows)
    assert model.languages == ["en", "fr"]
    texts = ["the", "théorie zq", "", "x", "of the other théâtre " * 5]
    raw, offsets = as_bytes(texts)
    for scorer in (langid.Scorer(model), langid.Scorer(model, slots=3, block=4)):  # a tiny table collides all the time
        for _ in range(2):
            got = scorer.text_bits(raw, offsets)
            want = [[brute_bits(t, x.encode()) for t in model.trees] for x in texts]
            assert np.allclose(got, want, rtol=1e-5, atol=1e-4)


@pytest.mark.parametrize("per_language", [1000, 5])
def test_prediction(spark, docs, rows, empty, per_language):
    rng = random.Random(3)
    kinds = {"en": "the and with for of ing tion".split(), "de": "der und mit für ung schaft ß".split()}
    texts = [(i, " ".join(rng.choices(kinds[lang], k=20)), lang) for i, lang in enumerate(["en", "de", "de"] * 60)] + [(999, None, "en"), (1000, "x y", None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    learnt = langid.training_rows(frame, per_language)
    assert len(learnt) <= 180 if per_language > 100 else len(learnt) < 60
    model = langid.LanguageModel.learn(learnt)
    got = {r["doc_id"]: r for r in langid.predict(frame, model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in texts[:-2]]) > 0.95
    assert (got[999]["lang_pred"], got[999]["score"]) == ("und", 0.0)
    told = langid.predict(docs, model).collect()
    assert len(told) == len(rows) and all(0 <= r["score"] <= 1 for r in told)
    by = {r["doc_id"]: r["lang_pred"] for r in told}
    for doc_id, text, *_ in rows[:-2]:
        assert (by[doc_id] == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.predict(empty, model).count() == 0
    nothing = langid.LanguageModel.learn(langid.training_rows(empty))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_a_language_of_long_texts_alone_is_learnt(spark):
    texts = [("aa", "short one"), ("aa", "long " * 30), ("bb", "only long " * 30), (None, "no language"), ("cc", "")]
    frame = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    assert langid.training_rows(frame, longest=20) == [("aa", "short one"), ("bb", ("only long " * 30)[:20])]
