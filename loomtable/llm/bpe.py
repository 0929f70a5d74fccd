"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping chunks; each chunk is pre-tokenised by itself, as if its first
character began a pre-token. Pre-tokenising runs left to right without memory, so two neighbouring
chunks agree from the first boundary that both have in their overlap (they *resynchronise* there).
The text is stitched at these places and its pieces are encoded; decoding joins the raw bytes of ids.

A chunk whose overlap has no common boundary (a run of letters longer than the overlap) is merged
with its neighbour, so the result equals encoding the whole text in every case. What is read in one
go doubles as long as nothing resynchronises, so a single endless run is read a few times only.

Chunks are read by another library than the encoder, whose character classes may be of another
Unicode version. Characters on which the two differ are read as stand-ins of the encoder's class.

Null and empty texts have no ids. Every row gives one row, repeated rows too; an empty table gives
none, and columns other than doc_id and text are not read.

Vocabularies are files named by a path; every executor has them at that path.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts, texts_of

#: Characters of a chunk, and of the overlap of two neighbours: most documents have several chunks.
CHUNK, OVERLAP = 1 << 10, 1 << 7
#: Characters of a chunk where ids are only a means (packing and counting).
LONG_CHUNK = 1 << 16


@lru_cache(maxsize=4)
def stand_ins(pattern: str) -> dict[int, int]:
    """Characters that the encoder's library puts in other classes of the pattern than the one that reads chunks,
    each with a character on whose classes both agree and that are those of the encoder."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    every = "".join(map(chr, points.tolist()))
    theirs, ours = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int64)
    for k, name in enumerate(sorted(set(regex.findall(r"\\[pP]\{\^?\w+\}|\\[sSdDwW]", pattern)))):
        chosen = bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        for found, classes in ((chosen, theirs), (regex.findall(name, every), ours)):
            classes[[ord(c) for c in found]] |= 1 << k
    agreed: dict[int, int] = {}
    for c in points[(points > 127) & (theirs == ours)[points]].tolist():
        agreed.setdefault(int(theirs[c]), c)
    return {c: agreed[int(theirs[c])] for c in points[(theirs != ours)[points]].tolist()}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.raw = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.raw[rank] = piece

    def boundaries(self, chunk: str) -> np.ndarray:
        """Starts of the pre-tokens of a chunk read by itself."""
        return np.fromiter((m.start() for m in self.pattern.finditer(chunk)), np.int64)

    def pieces(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[str]:
        """Pre-tokenises overlapping chunks by themselves and cuts the text where two neighbours resynchronise.

        The first chunk is in step from its start. A boundary that it shares with the next one, before
        its own last two (which its end may have cut short), puts the next one in step from there on.
        """
        size, begun, nxt, step = len(text), 0, chunk, chunk
        if size <= chunk:
            yield text
            return
        read = text
        if not text.isascii():
            other = stand_ins(self.encoding._pat_str)
            read = text if other.keys().isdisjoint(map(ord, set(text))) else text.translate(other)
        left = self.boundaries(read[: chunk + overlap])
        while nxt < size:
            right = nxt + self.boundaries(read[nxt : nxt + chunk + overlap])
            shared = np.intersect1d(left[left > nxt][:-2], right, assume_unique=True)
            cut = next((int(p) for p in shared if not text[p - 1].isspace()), None)
            if cut is None:  # no common boundary: read on from the last cut, over both chunks and more each time
                step *= 2
                left = begun + self.boundaries(read[begun : nxt + step + overlap])
                nxt += step
            else:
                yield text[begun:cut]
                begun, left, step = cut, right[right >= cut], chunk
                nxt += chunk
        yield text[begun:]

    def encode_packed(self, text: str, chunk: int = CHUNK) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, as the library encodes the whole text."""
        return b"".join([array("I", self.encoding.encode_ordinary(p)).tobytes() for p in self.pieces(text, chunk)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<long>, decoded binary) of every text. Null is an empty text; repeated rows give repeated rows."""

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        ids = [c.encode(t) for t in texts_of(batch)]
        return {"doc_id": batch.column(0).cast(pa.int64()), "ids": pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())), "decoded": pa.array([c.decode(i.tolist()) for i in ids], pa.binary())}

    return map_texts(docs, "doc_id long, ids array<bigint>, decoded binary", work)


def encoded_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encode_documents returns, without moving ids."""
    from hashlib import sha256

    def work(batch: pa.RecordBatch) -> dict:
        c, out = codec(ranks_path, pattern), ([], [], [])
        for text in texts_of(batch):
            packed = c.encode_packed(text)
            ids = np.frombuffer(packed, "<u4").tolist()
            for column, value in zip(out, (len(ids), sha256(packed).hexdigest(), sha256(c.decode(ids)).hexdigest()), strict=True):
                column.append(value)
        return {"doc_id": batch.column(0).cast(pa.int64()), "n_tokens": pa.array(out[0], pa.int64()), "ids_sha256": pa.array(out[1], pa.string()), "decoded_sha256": pa.array(out[2], pa.string())}

    return map_texts(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
