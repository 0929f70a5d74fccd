"""Audio columns and the url filter."""

import json
import math
import zlib
from hashlib import sha256

import numpy as np
import pytest

from loomtable.llm import audio, urls


def test_tables_of_companded_codes():
    mu, a = audio.mu_law_table(), audio.a_law_table()
    assert mu[0] == -32124 and mu[0x7F] == 0 and mu[0xFF] == 0 and mu[0x80] == 32124
    assert sorted(set(mu.tolist())) == sorted(set((-mu).tolist())) and len(set(mu.tolist())) == 255
    assert a[0xD5] == 8 and a[0x55] == -8 and a.max() == 32256 and a.min() == -32256 and len(set(a.tolist())) == 256


def test_wav_round_trip():
    for tag in (audio.MU_LAW, audio.A_LAW):
        data = bytes(range(256)) + b"x"
        w = audio.read_wav(audio.wav(data, tag))
        assert (w["data"], w["tag"], w["rate"], w["bits"]) == (data, tag, 8000, 8)
    with pytest.raises(ValueError):
        audio.read_wav(b"nothing")


def slow_adpcm(block: bytes) -> list[int]:
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = block[2], [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            move = step >> 3
            if code & 1:
                move += step >> 2
            if code & 2:
                move += step >> 1
            if code & 4:
                move += step
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_adpcm():
    rng = np.random.default_rng(3)
    blocks = [int(rng.integers(-30000, 30000)).to_bytes(2, "little", signed=True) + bytes([int(rng.integers(0, 89)), 0]) + rng.bytes(60) for _ in range(20)]
    assert audio.decode_adpcm(b"".join(blocks) + b"cut", 64).tolist() == sum(map(slow_adpcm, blocks), [])
    tone = (8000 * np.sin(np.arange(5000) * 0.05)).astype(np.int16)
    back = audio.decode_adpcm(audio.encode_adpcm(tone), 256)[:5000]
    assert np.abs(back[50:].astype(int) - tone[50:]).mean() < 200
    assert len(audio.decode_adpcm(b"", 256)) == 0 and audio.encode_adpcm(tone[:0]) == b""
    pcm, rate = audio.to_pcm(audio.wav(audio.encode_adpcm(tone), audio.IMA_ADPCM, bits=4, block=256, samples_per_block=505))
    assert rate == 8000 and (pcm[:5000] == back).all()


def test_resampling():
    x = np.array([0, 100, -100], np.int16)
    assert audio.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert audio.resample(x, 8000, 8000).tolist() == x.tolist() and len(audio.resample(x[:0], 8000, 16000)) == 0


def test_stored_texts(docs, rows, empty):
    by, used = {}, set()
    for r in audio.stored_texts(docs).collect():
        raw = next((x[1] or "") for x in rows if x[0] == r["doc_id"] and (r["doc_id"] is not None or len((x[1] or "").encode()) == r["n_bytes"])).encode()
        size = max(64, math.ceil(len(raw) / 64) * 64)
        payload = raw + b"\0" * (size - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), size, sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        tag = {"mu-law": audio.MU_LAW, "a-law": audio.A_LAW, "adpcm": audio.IMA_ADPCM}[r["codec"]]
        media = audio.wav(payload, tag, bits=4, block=64, samples_per_block=121) if tag == audio.IMA_ADPCM else audio.wav(payload, tag)
        assert r["media_bytes"] == len(media) and r["media_sha256"] == sha256(media).hexdigest()
        pcm, rate = audio.to_pcm(media)
        twice = [v for k, a in enumerate(pcm.tolist()) for v in (a, a + (pcm.tolist()[min(k + 1, len(pcm) - 1)] - a) // 2)] if len(pcm) < 2000 else audio.resample(pcm, rate, 16000).tolist()
        assert r["pcm_sha256"] == sha256(audio.wav(np.array(twice, "<i2").tobytes(), audio.PCM, 16000, 16)).hexdigest()
        if len(pcm) < 2000:
            x = np.array(twice, float)
            assert json.loads(r["feature"]) == {"samples": len(x), "rate": 16000, "rms": round(float(np.sqrt((x * x).mean())), 3), "peak": int(np.abs(x).max()), "mean": round(float(x.mean()), 3), "crossings": int(((x[1:] < 0) != (x[:-1] < 0)).sum())}
        used.add(tag)
        assert by.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
    assert len(used) == 3
    assert audio.stored_texts(docs).count() == len(rows) and audio.stored_texts(empty).count() == 0


def test_media_column(spark):
    media = audio.wav(bytes(range(256)), audio.A_LAW)
    got = {r["doc_id"]: r for r in audio.media_column(spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")).collect()}
    w = audio.read_wav(bytes(got[1]["pcm"]))
    assert (w["rate"], w["bits"], w["tag"], len(w["data"])) == (16000, 16, audio.PCM, 1024) and got[2]["pcm"] is None


# --- urls

URLS = [
    ("https://Blog.Example.COM/en/1?x=1#y", "blog.example.com", "/en/1", "example.com/en/", "block"),
    ("http://www.example.com/en/a", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("http://a.example.com/fr/", "a.example.com", "/fr/", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"),
    ("http://a.com?q=/", "a.com", "", None, None),
    ("http://notcom/", "notcom", "/", None, None),
    ("http://example.com.evil.org/en/", "example.com.evil.org", "/en/", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("://h/p://q", "h", "/p://q", None, None),
    ("http://ÀB.org/É", "Àb.org", "/É", None, None),
]


def test_urls(spark):
    frame = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    model = urls.train(urls.labelled_urls())
    got = {r["page_id"]: r for r in urls.judge(frame, model).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))
    assert urls.judge(frame.limit(0), model).count() == 0


def test_the_model_learns_its_table_and_more():
    rows = urls.labelled_urls()
    model = urls.train(rows)
    split = lambda u: (u.split("/")[2], "/" + u.split("/", 3)[3].split("?")[0].split("#")[0])
    assert all((model.score(*split(u)) >= 0.5) == bool(y) for u, y in rows)
    assert model.score("www.casino-bonus.example.org", "/it/9") > 0.5 > model.score("ththed.example.org", "/en/453")


def test_a_short_last_block_of_adpcm():
    tone = (9000 * np.sin(np.arange(1200) / 9)).astype(np.int16)
    data = audio.encode_adpcm(tone)
    whole = audio.decode_adpcm(data, 256)
    for size in (515, 516, 517, 600, 767):
        got = audio.decode_adpcm(data[:size], 256)
        assert len(got) == 1010 + (2 * (size - 516) + 1 if size >= 516 else 0) and (got == whole[: len(got)]).all()
    media = audio.wav(data[:600], audio.IMA_ADPCM, bits=4, block=256, samples_per_block=505)
    assert len(audio.to_pcm(media)[0]) == 1179
    at = media.index(b"fact") + 8
    for told in (1010, 1100, 1178):
        assert len(audio.to_pcm(media[:at] + told.to_bytes(4, "little") + media[at + 4 :])[0]) == told


def test_media_that_cannot_be_read(spark):
    good = audio.wav(bytes(range(64)), audio.MU_LAW)
    bad = [b"", b"RIFF", b"no audio at all", good[:14], good[:30], good[: good.index(b"data")], good[:20] + b"\x63\0" + good[22:], good[:24] + b"\0\0\0\0" + good[28:]]
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([*bad, good])] + [(None, bytearray(good))], "doc_id long, media binary")
    got = audio.media_column(frame).collect()
    assert len(got) == len(bad) + 2
    for r in got:
        assert (r["pcm"] is None and "error" in r["feature"]) if r["doc_id"] is not None and r["doc_id"] < len(bad) else r["pcm"]
    assert audio.media_column(frame.limit(0)).count() == 0


def test_stereo_becomes_the_mean():
    pcm = np.array([100, 300, -100, -301, 7], "<i2")
    media = bytearray(audio.wav(pcm.tobytes(), audio.PCM, bits=16))
    media[22] = 2
    assert audio.to_pcm(bytes(media))[0].tolist() == [200, -201]


def test_no_host_name_of_the_labelled_table_is_judged(spark):
    host = lambda u: u.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower()
    name = lambda h: h.split(".")[-3] if h.count(".") >= 2 else h
    judged = {name(host(r[0])) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect() if r[0] and "://" in r[0]}
    assert judged and not judged & {name(host(u)) for u, _ in urls.labelled_urls()}


def _grams(host, path, bits):
    """The n-grams one at a time, with plain integers."""
    out, top = set(), (1 << 64) - 1
    for salt, part in ((1, "^" + host + "$"), (2, path + "$")):
        raw = [48 if 48 <= c < 58 else c for c in part.encode()]
        for n in (3, 4, 5):
            for i in range(len(raw) - n + 1):
                h = salt * 1_000_003 + n
                for c in raw[i : i + n]:
                    h = (h ^ c) * 0x100000001B3 & top
                out.add(((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 & top) >> (64 - bits))
    return sorted(out)


def test_ngrams_and_regression_against_plain_python():
    for host, path in (("a.example.com", "/en/12"), ("", ""), ("x", "/"), ("é.org", "/ü" * 50)):
        assert urls.hashed_ngrams(host, path).tolist() == _grams(host, path, urls.BITS)
    rows = [("http://good.org/a", 0), ("http://bad-spam.com/b?x", 1), ("http://fine.net/c#y", 0), ("https://Spam-bad.org", 1)]
    parts = [("good.org", "/a"), ("bad-spam.com", "/b"), ("fine.net", "/c"), ("spam-bad.org", "")]
    w, b, order = {}, 0.0, np.random.default_rng(7)
    for _ in range(5):
        for i in order.permutation(4):
            f = _grams(*parts[i], 12)
            n = math.sqrt(max(1, len(f)))
            g = 1 / (1 + math.exp(-(b + sum(w.get(k, 0.0) for k in f) / n))) - rows[i][1]
            for k in f:
                w[k] = w.get(k, 0.0) - 0.5 * (g / n + 1e-3 * w.get(k, 0.0))
            b -= 0.5 * 0.1 * g
    model = urls.train(rows, bits=12, rounds=5)
    assert abs(model.bias - b) < 1e-9
    for host, path in parts:
        f = _grams(host, path, 12)
        z = b + sum(w.get(k, 0.0) for k in f) / math.sqrt(max(1, len(f)))
        assert abs(model.score(host, path) - 1 / (1 + math.exp(-z))) < 1e-5
