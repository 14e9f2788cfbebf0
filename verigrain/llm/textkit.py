"""What the operators that run Python over Arrow batches share: whole texts as bytes, words, stable hashes."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Lower-cases A-Z, keeps digits and all bytes of non-ASCII characters, and turns every other ASCII byte into a blank.
WORD_BYTES = bytes(
    ord(chr(b).lower()) if b >= 128 or chr(b) in string.ascii_letters + string.digits else 32 for b in range(128)
) + bytes(range(128, 256))

#: Rows handled at a time, whatever size of batch Spark sends.
ROWS_AT_A_TIME = 256


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def slices(array: pa.Array) -> Iterator[pa.Array]:
    for at in range(0, max(len(array), 1), ROWS_AT_A_TIME):
        yield array.slice(at, ROWS_AT_A_TIME)


def sliced_by_bytes(batch: pa.RecordBatch, text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose column ``text`` has at most ``limit`` bytes, or one row if that is longer."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(int(np.searchsorted(sizes, done + limit, "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


class HashOf(dict):
    """word -> 64-bit hash, remembered; forgets everything when it holds ``limit`` words, which changes no result."""

    def __init__(self, mix: Callable[[bytes], int] = xxhash.xxh3_64_intdigest, limit: int = 400_000):
        super().__init__()
        self.mix, self.limit = mix, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = self.mix(word)
        return value

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
