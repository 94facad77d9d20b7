"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words per shingle.
WIDTH = 5
#: Text bytes that are hashed at once, beyond one document.
CHUNK = 4 << 20
# Odd multipliers of the positions in a shingle, and the mixing constants of the finishing step.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class WordHashes(dict):
    """Hash of each word, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def finish(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], words: WordHashes) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; a text of fewer words than ``WIDTH`` is one shingle.

    ASCII letters are lower-cased; words are runs of signs other than ASCII white space, as ``bytes.split`` cuts
    them. Null texts and texts without words have the empty set.
    """
    split = [t.lower().split() if t else [] for t in texts]
    flat = [w for s in split for w in s]
    hashes = np.fromiter(map(words.__getitem__, flat), np.uint64, len(flat))
    rolled = np.zeros(max(0, len(flat) - WIDTH + 1), np.uint64)
    for i in range(WIDTH):
        rolled += hashes[i : i + len(rolled)] * np.uint64(MULTIPLIERS[i])
    rolled = finish(rolled)
    out, at = [], 0
    for s in split:
        n = len(s)
        if n >= WIDTH:
            one = np.sort(rolled[at : at + n - WIDTH + 1])
            out.append(one[np.r_[True, one[1:] != one[:-1]]])
        elif n:
            h = hashes[at : at + n] * np.array(MULTIPLIERS[:n], np.uint64)
            out.append(finish(np.array([h.sum(dtype=np.uint64) ^ np.uint64(n)])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Batches cut into runs of documents of about ``CHUNK`` bytes, with the texts as UTF-8 bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        start = 0
        while start < len(column):
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + CHUNK)))
            end = min(end, len(column))
            yield batch.slice(start, end - start), column.slice(start, end - start).to_pylist()
            start = end
