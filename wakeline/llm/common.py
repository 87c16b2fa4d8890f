"""Helpers shared by the text operators: words and lines in SQL, and numpy word hashes over Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What separates words: space and the control characters from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; an empty array where there are none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def drawn(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, those of the keys lowest in a hash. Only keys are sorted; rows without key are never drawn."""
    lot = F.xxhash64(key)
    keys = docs.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(lot, key).limit(n)
    # broadcast: at most n keys
    return docs.join(F.broadcast(keys), key, "left_semi").limit(n)


# numpy: words of many texts at once -------------------------------------------------------------------------------

#: Odd 64-bit constants of the hash functions (any fixed odd numbers serve).
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_FOLD = [np.uint64(int(_BASE * (2 * i + 3) ** 7 + 2 * i) % 2**64 | 1) for i in range(16)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(n, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def chunks(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut an Arrow text column into runs of whole texts: first row, bytes, offsets of the texts in them.

    A run holds at most ``most_bytes`` unless one text alone is longer; nulls count as empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z as a-z) and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | border[:n]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    low = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    up, down = POWERS.to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up + up, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    per_text = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return h, per_text


def shingles(h: np.ndarray, per_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, and their number for each text.

    A text of 1 to k-1 words has one shingle, the whole sequence.
    """
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]]).astype(np.int64)
    n = np.where(per_text >= k, per_text - k + 1, np.minimum(per_text, 1))
    owner = np.repeat(np.arange(len(n)), n)
    begin = np.repeat(first, n) + np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    size = np.minimum(per_text, k)[owner]
    s = size.astype(np.uint64) * _STEP
    wide = np.concatenate([h, np.zeros(k, np.uint64)])
    for i in range(k):
        s += np.where(size > i, wide[begin + i], np.uint64(0)) * _FOLD[i]
    s = mix(s)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.bincount(owner[new], minlength=len(n))
