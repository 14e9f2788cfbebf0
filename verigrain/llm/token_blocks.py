"""Token ids in patched frame-of-reference blocks: the codec, without Spark.

A block holds ``BLOCK`` ids. Their minimum is subtracted and the differences are packed at the width that holds a given
percentile of them. Differences that are wider keep their low bits in place; the list of exceptions has their
positions and high bits.

A shard file is ``MAGIC``, blocks, the index and a trailer, all little-endian:

    block     u32 minimum, u8 width, u16 exceptions, u16 ids; BLOCK * width / 8 bytes; u16 positions; u32 high bits
    index     u64 start of each block in the file; i64 document ids; a bit for each id that is not null; u64 lengths
    trailer   u64 blocks, u64 documents, u64 ids, u32 crc32 of the index, u32 BLOCK, ``MAGIC``

The last block is filled up with its minimum; its header tells how many ids count.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np

BLOCK = 1024
MAGIC = b"PFORTOK1"
HEADER = struct.Struct("<IBHH")
TRAILER = struct.Struct("<QQQII8s")
#: Blocks that are coded or decoded at a time: some MB of bits.
BLOCKS_AT_A_TIME = 256


def _packed(low: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bits of each number of each row, as bytes."""
    wide = np.ascontiguousarray(low.astype("<u4")).view(np.uint8).reshape(*low.shape, 4)
    bits = np.unpackbits(wide[..., : -(-width // 8)], axis=-1, bitorder="little")[..., :width]
    return np.packbits(bits.reshape(len(low), -1), axis=1, bitorder="little")


def _unpacked(data: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(data, axis=1, bitorder="little").reshape(len(data), -1, width)
    wide = np.zeros((*bits.shape[:2], 4), np.uint8)
    wide[..., : -(-width // 8)] = np.packbits(bits, axis=-1, bitorder="little")
    return wide.view("<u4")[..., 0]


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """``ids`` (below 2**32) as blocks; the last one may be short. No id gives no block."""
    out: list[bytes] = []
    for at in range(0, len(ids), BLOCK * BLOCKS_AT_A_TIME):
        part = np.asarray(ids[at : at + BLOCK * BLOCKS_AT_A_TIME], np.uint32)
        rows = -(-len(part) // BLOCK)
        counts = np.full(rows, BLOCK)
        counts[-1] = len(part) - BLOCK * (rows - 1)
        full = np.full(rows * BLOCK, part[BLOCK * (rows - 1) :].min(), np.uint32)
        full[: len(part)] = part
        full = full.reshape(rows, BLOCK)
        least = full.min(axis=1)
        delta = full - least[:, None]
        place = min(int(np.ceil(percentile * BLOCK)), BLOCK) - 1
        typical = np.partition(delta, place, axis=1)[:, place]
        width = np.where(typical > 0, np.floor(np.log2(np.maximum(typical, 1).astype(np.float64))) + 1, 0).astype(int)
        high = (delta.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
        bodies: dict[int, np.ndarray] = {}
        for w in np.unique(width[width > 0]).tolist():
            chosen = np.flatnonzero(width == w)
            bodies |= dict(zip(chosen.tolist(), _packed(delta[chosen], w), strict=True))
        for k in range(rows):
            places = np.flatnonzero(high[k])
            head = HEADER.pack(int(least[k]), int(width[k]), len(places), int(counts[k]))
            body = bodies[k].tobytes() if k in bodies else b""
            out.append(head + body + places.astype("<u2").tobytes() + high[k][places].astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    heads = [HEADER.unpack_from(data, at) for at in starts.tolist()]
    raw = np.frombuffer(data, np.uint8)
    width = np.array([h[1] for h in heads], int)
    out = np.zeros((len(heads), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        out[chosen] = _unpacked(np.stack([raw[a : a + size] for a in (starts[chosen] + HEADER.size).tolist()]), w)
    for k, (least, w, exceptions, _) in enumerate(heads):
        if exceptions:
            at = int(starts[k]) + HEADER.size + BLOCK * w // 8
            places = np.frombuffer(data, "<u2", exceptions, at)
            out[k, places] += np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions) << np.uint32(w)
        out[k] += np.uint32(least)
    counts = [h[3] for h in heads]
    return out.ravel() if all(c == BLOCK for c in counts) else np.concatenate([r[:c] for r, c in zip(out, counts, strict=True)])


class ShardWriter:
    """Writes documents one after the other; holds less than a chunk of blocks and the index."""

    def __init__(self, sink: BinaryIO, percentile: float = 0.9):
        self.sink, self.percentile = sink, percentile
        self.rest: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.starts: list[int] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK * BLOCKS_AT_A_TIME:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        for block in encode_blocks(ids[:n], self.percentile):
            self.starts.append(self.at)
            self.at += self.sink.write(block)
        self.rest, self.waiting = [ids[n:].copy()], len(ids) - n

    def finish(self) -> None:
        self._flush(self.waiting)
        known = np.array([i is not None for i in self.doc_ids], bool)
        index = b"".join((
            np.array(self.starts, "<u8").tobytes(), np.array([i or 0 for i in self.doc_ids], "<i8").tobytes(),
            np.packbits(known, bitorder="little").tobytes(), np.array(self.lengths, "<u8").tobytes(),
        ))
        self.sink.write(index)
        self.sink.write(TRAILER.pack(len(self.starts), len(self.doc_ids), self.n_ids, zlib.crc32(index), BLOCK, MAGIC))


class Document(NamedTuple):
    doc_id: int | None
    start: int
    n_tokens: int
    ids_crc32: int
    ids: np.ndarray | None


class ShardReader:
    """Random access to a shard: the index is read at once, blocks where they are wanted."""

    def __init__(self, source: BinaryIO, size: int):
        self.source = source
        source.seek(size - TRAILER.size)
        blocks, docs, self.n_ids, crc, block, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a token shard of this format")
        bits = -(-docs // 8)
        length = 8 * blocks + 16 * docs + bits
        source.seek(size - TRAILER.size - length)
        index = source.read(length)
        if zlib.crc32(index) != crc:
            raise ValueError("the index of the token shard is damaged")
        self.starts = np.append(np.frombuffer(index, "<u8", blocks).astype(np.int64), size - TRAILER.size - length)
        at = 8 * blocks
        self.doc_ids = np.frombuffer(index, "<i8", docs, at)
        self.known = np.unpackbits(np.frombuffer(index, np.uint8, bits, at + 8 * docs), count=docs, bitorder="little").astype(bool)
        self.ends = np.cumsum(np.frombuffer(index, "<u8", docs, at + 8 * docs + bits).astype(np.int64))
        self.begins = np.concatenate([[0], self.ends[:-1]])[:docs]

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from place ``begin`` to ``end`` of the shard, decoding only the blocks that hold them."""
        if end <= begin:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        self.source.seek(int(self.starts[first]))
        data = self.source.read(int(self.starts[last] - self.starts[first]))
        found = decode_blocks(data, self.starts[first:last] - self.starts[first])
        return found[begin - first * BLOCK : end - first * BLOCK]

    def documents(self, begin: int, end: int, with_ids: bool = False) -> Iterator[Document]:
        """The documents whose first id lies from place ``begin`` to ``end`` of the shard, a chunk of blocks at a time."""
        first, last = np.searchsorted(self.begins, [begin, end], "left")
        held, held_at = np.zeros(0, np.uint32), 0
        for k in range(first, last):
            at, until, crc, parts = int(self.begins[k]), int(self.ends[k]), 0, []
            place = at
            while place < until:
                if not held_at <= place < held_at + len(held):
                    held_at = place // BLOCK * BLOCK
                    held = self.ids(held_at, min(held_at + BLOCK * BLOCKS_AT_A_TIME, self.n_ids))
                part = held[place - held_at : until - held_at]
                crc = zlib.crc32(np.ascontiguousarray(part, "<u4"), crc)
                if with_ids:
                    parts.append(part)
                place += len(part)
            ids = (np.concatenate(parts) if parts else np.zeros(0, np.uint32)) if with_ids else None
            yield Document(int(self.doc_ids[k]) if self.known[k] else None, at, until - at, crc, ids)
