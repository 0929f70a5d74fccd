"""Telephony audio columns: mu-law, A-law and ADPCM in WAV containers, expanded to PCM and resampled.

mu-law and A-law bytes expand by lookup tables of 256 entries, made from their formulas. IMA ADPCM
is decoded block by block in its standard layout; the loop runs over the samples of a block, while
numpy works across all blocks at once. Resampling is linear; the PCM is stored as 16-bit WAV.

Every function takes and returns whole byte strings, of any length; empty audio stays empty.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Format tags of WAV, and the rate of telephony.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
RATE = 8000
CODECS = {MU_LAW: "mu-law", A_LAW: "a-law", IMA_ADPCM: "adpcm"}
#: Samples that are resampled or measured at a time.
BLOCK = 1 << 20
#: Fixed values of IMA ADPCM: how a 4-bit code moves the step index.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)


def _steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: each is about a tenth above the one before."""
    out = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return np.array(out, np.int64)


STEPS = _steps()


def mu_law_table() -> np.ndarray:
    """PCM of the 256 mu-law codes: complemented sign, three bits of exponent, four of mantissa, bias 132."""
    c = ~np.arange(256, dtype=np.uint8)
    size = (((c & 15).astype(np.int32) << 3) + 132 << ((c >> 4) & 7).astype(np.int32)) - 132
    return np.where(c & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """PCM of the 256 A-law codes: even bits inverted; a set sign bit is positive."""
    c = (np.arange(256) ^ 0x55).astype(np.int32)
    e, m = (c >> 4) & 7, (c & 15) << 4
    size = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(c & 128, size, -size).astype(np.int16)


EXPAND = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def wav(data: bytes, tag: int, rate: int = RATE, bits: int = 8, block: int | None = None, samples_per_block: int = 0) -> bytes:
    """A mono WAV file around the samples; formats other than PCM carry a fact chunk with their number."""
    align = block or bits // 8
    per_second = rate * align if not samples_per_block else rate * align // samples_per_block
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits)
    n = len(data) // align * samples_per_block + max(0, (len(data) % align - 4) * 2 + 1) if samples_per_block else len(data) // align
    if tag == IMA_ADPCM:
        fmt += struct.pack("<HH", 2, samples_per_block)
    elif tag != PCM:
        fmt += struct.pack("<H", 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if tag != PCM:
        chunks += b"fact" + struct.pack("<II", 4, n)
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> dict:
    """tag, rate, bits, align, samples_per_block, data and, if told, samples of a WAV file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, out = 12, {"samples_per_block": 0}
    fields = {"fmt ": 16, "fact": 4, "data": 0}
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + fields.get(kind.decode("latin-1"), 0) > len(media):
            raise ValueError("a WAV file that ends inside a chunk")
        if kind == b"fmt ":
            out["tag"], out["channels"], out["rate"], _, out["align"], out["bits"] = struct.unpack_from("<HHIIHH", media, at + 8)
            if out["tag"] == IMA_ADPCM and at + 28 <= len(media):
                out["samples_per_block"] = struct.unpack_from("<H", media, at + 26)[0]
        elif kind == b"fact" and size >= 4:
            out["samples"] = struct.unpack_from("<I", media, at + 8)[0]
        elif kind == b"data":
            out["data"] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if "tag" not in out or "data" not in out:
        raise ValueError("a WAV file without format or data")
    return out


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """16-bit samples of mono IMA ADPCM blocks (4-byte head: first sample, step index).

    A short last block gives its first sample and those of the codes it has; one cut in its head gives none.
    """
    rest = len(data) % block
    n = len(data) // block * ((block - 4) * 2 + 1) + ((rest - 4) * 2 + 1 if rest >= 4 else 0)
    data = data + b"\0" * (block - rest) if rest >= 4 else data[: len(data) - rest]
    blocks = np.frombuffer(data, np.uint8).reshape(-1, block)
    if not blocks.size:
        return np.zeros(0, np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), len(STEPS) - 1)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code, step = codes[:, k], STEPS[index]
        move = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out.reshape(-1)[:n]


def encode_adpcm(pcm: np.ndarray, block: int = 256) -> bytes:
    """IMA ADPCM blocks of 16-bit samples, across all blocks at once; the last block is filled with its last sample."""
    each = (block - 4) * 2 + 1
    if not len(pcm):
        return b""
    rows = -(-len(pcm) // each)
    x = np.concatenate([pcm, np.full(rows * each - len(pcm), pcm[-1], pcm.dtype)]).reshape(rows, each).astype(np.int64)
    value, index = x[:, 0].copy(), np.zeros(rows, np.int64)
    out = np.zeros((rows, block), np.uint8)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(rows, 2)
    codes = np.empty((rows, each - 1), np.int64)
    for k in range(1, each):
        step, gap = STEPS[index], x[:, k] - value
        code, rest = np.where(gap < 0, 8, 0), np.abs(gap)
        move = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            has = rest >= part
            code, rest, move = np.where(has, code | bit, code), np.where(has, rest - part, rest), np.where(has, move + part, move)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, len(STEPS) - 1)
        codes[:, k - 1] = code
    out[:, 4:] = (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)
    return out.tobytes()


def to_pcm(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a WAV file in any of the formats; several channels become their mean."""
    w = read_wav(media)
    if not w["rate"]:
        raise ValueError("a rate of 0")
    if w["tag"] in EXPAND:
        return _mono(EXPAND[w["tag"]][np.frombuffer(w["data"], np.uint8)], w["channels"]), w["rate"]
    if w["tag"] == IMA_ADPCM and w["channels"] == 1 and w["align"] > 4:
        return decode_adpcm(w["data"], w["align"])[: w.get("samples") or None], w["rate"]
    if w["tag"] == PCM and w["bits"] == 16:
        return _mono(np.frombuffer(w["data"][: len(w["data"]) // 2 * 2], "<i2"), w["channels"]), w["rate"]
    raise ValueError(f"format {w['tag']} with {w['bits']} bits and {w['channels']} channels")


def _mono(pcm: np.ndarray, channels: int) -> np.ndarray:
    """The mean of interleaved channels, rounded down; samples of an incomplete last instant go."""
    if channels <= 1:
        return pcm
    whole = pcm[: len(pcm) // channels * channels].reshape(-1, channels)
    return (whole.sum(axis=1, dtype=np.int64) // channels).astype(np.int16)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate's instants, a block of instants at a time."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * to // rate
    out = np.empty(n, np.int16)
    for start in range(0, n, BLOCK):
        at = np.arange(start, min(n, start + BLOCK), dtype=np.int64) * rate
        i, part = at // to, at % to
        a, b = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
        out[start : start + len(at)] = a + (b - a) * part // to
    return out


def features(pcm: np.ndarray, rate: int) -> str:
    """Level, peak, offset and zero crossings, as JSON; whole sums of blocks."""
    n, squares, total, peak = len(pcm), 0, 0, 0
    for start in range(0, n, BLOCK):
        x = pcm[start : start + BLOCK].astype(np.int64)
        squares, total, peak = squares + int((x * x).sum()), total + int(x.sum()), max(peak, int(np.abs(x).max()))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0))) if n else 0
    return json.dumps({"samples": n, "rate": rate, "rms": round(math.sqrt(squares / n), 3) if n else 0.0, "peak": peak, "mean": round(total / n, 3) if n else 0.0, "crossings": crossings})


def store_pcm(media: bytes, rate: int = 16000) -> bytes:
    """The stored form of a recording: 16-bit PCM WAV at the given rate."""
    pcm, own = to_pcm(media)
    return wav(resample(pcm, own, rate).astype("<i2").tobytes(), PCM, rate, 16)


def media_column(media: DataFrame, rate: int = 16000) -> DataFrame:
    """(doc_id, pcm, feature) of a table (doc_id, media): every recording as resampled PCM.

    Null media gives nulls. Bytes that can't be read give a null pcm, and their feature names the fault. Each row gives
    one row, repeated ones too; an empty table gives none, and other columns are not read.
    """

    def measured(raw: bytes | None) -> tuple[bytes | None, str | None]:
        if raw is None:
            return None, None
        try:
            return store_pcm(raw, rate), features(*to_pcm(raw))
        except ValueError as fault:
            return None, json.dumps({"error": str(fault)})

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one recording at a time bounds memory
                pcm, told = measured(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1).cast(pa.int64()), pa.array([pcm], pa.binary()), pa.array([told], pa.string())], ["doc_id", "pcm", "feature"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, pcm binary, feature string")


def payload_of(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def stored_payload(payload: bytes) -> bytes:
    """The payload as a WAV file in one of the three formats, which its checksum chooses; each keeps every byte.

    mu-law and A-law: a byte is a sample. ADPCM: 64 bytes are a block (a head of four bytes, 120 codes).
    """
    tag = (MU_LAW, A_LAW, IMA_ADPCM)[zlib.crc32(payload) % 3]
    return wav(payload, tag, bits=4, block=64, samples_per_block=121) if tag == IMA_ADPCM else wav(payload, tag)


def expanded(media: list[bytes]) -> list[np.ndarray]:
    """The samples of stored payloads; the ADPCM blocks of all of them are decoded in one go."""
    told = [read_wav(m) for m in media]
    blocks = [w["data"] for w in told if w["tag"] == IMA_ADPCM]
    flat, at, out = decode_adpcm(b"".join(blocks), 64), 0, []
    for w in told:
        if w["tag"] == IMA_ADPCM:
            out.append(flat[at : at + w["samples"]])
            at += w["samples"]
        else:
            out.append(EXPAND[w["tag"]][np.frombuffer(w["data"], np.uint8)])
    return out


def stored_texts(docs: DataFrame, rate: int = 16000) -> DataFrame:
    """Stores every text's payload as mu-law, A-law or ADPCM, reads it back and expands it; stores the resampled PCM,
    and measures what is read back of that.

    Null is an empty text (64 zero bytes); equal texts give equal values; long texts are one recording. Repeated rows
    repeat, an empty table gives none, and columns other than doc_id and text are not read.
    """
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "pcm_bytes", "pcm_sha256")

    def work(batch: pa.RecordBatch) -> dict:
        raws = [(text or "").encode() for text in batch.column(1).to_pylist()]
        stored = [stored_payload(payload_of(raw)) for raw in raws]
        rows: list[tuple] = []
        for doc_id, raw, media, pcm in zip(batch.column(0).to_pylist(), raws, stored, expanded(stored), strict=True):
            told = read_wav(media)
            back = told["data"]
            kept = wav(resample(pcm, told["rate"], rate).astype("<i2", copy=False).tobytes(), PCM, rate, 16)
            rows.append((doc_id, len(raw), len(back), sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), sha256(media).hexdigest(), features(*to_pcm(kept)), CODECS[told["tag"]], len(kept), sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
        return {n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))}

    return map_texts(docs, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm_bytes long, pcm_sha256 string", work)
