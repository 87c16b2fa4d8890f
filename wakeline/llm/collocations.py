"""Phrase collocations by partitioned mining (SON).

The corpus is dealt into a few shards, each a set of tasks. Every shard is mined completely at a support
lowered in proportion: a phrase with ``support`` occurrences in all has at least ``support / shards`` in some
shard. Mining goes by length, as no phrase is more frequent than its parts: words, then pairs of locally
frequent words, then triples of locally frequent pairs. The union of what is frequent in some shard is the
candidate set; it misses no frequent phrase. A last pass counts all occurrences of all candidates, as exact
strings; what fell in only by chance drops out there.

Candidate sets travel as bitmaps of hashes (at most ``MOST_BITS`` bits, 32 MB, whatever the corpus): a full
bitmap lets more phrases through to the exact count and changes no result. Shards have hashes for
phrases; equal hashes only add candidates. Counts are combined inside tasks and before every shuffle, so a
frequent phrase is one row a task.

Defined results: words are maximal runs without space and tab in the pieces between ``.,;:!?`` and line
ends; A-Z count as a-z. A null text is empty, a null language is ``und``. Phrases don't cross pieces. Long
texts are read in windows cut at piece ends. Repeated rows count each; other columns are ignored, also
where their names clash. A language without candidate has no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.llm.common import POWERS, mix, whole_text
from wakeline.session import saved

#: Bits of a candidate bitmap.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bits in a chunk of a bitmap (8 KB).
CHUNK_BITS = 1 << 16
#: Bytes of text looked at together.
WINDOW_BYTES = 1 << 19
#: Bytes of counted phrases a task holds before it gives them out, and rows it gives out together.
HELD_BYTES, GIVEN_ROWS = 1 << 24, 1 << 15
#: Columns of counted phrases.
COUNTED = ["lang", "phrase", "words", "c"]

#: Class of each byte: 0 in a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = 2
#: Odd constants that tell the places in a phrase apart (any odd numbers serve).
_PLACE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


@dataclass(frozen=True)
class Mining:
    support: int = 10
    longest: int = 3
    #: Fewer shards mean a higher support in each and fewer candidates; at most half the support, so that it is 2 or more.
    shards: int = 2
    cover_percent: int = 50
    most: int = 2000

    def local_support(self) -> int:
        return -(-self.support // self.shards)


def windows(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Language, shard, bytes and text starts of runs of texts in one language and shard; long texts are cut at piece ends."""
    langs, shards, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.large_string())
    for pair in pa.table([langs, shards], ["lang", "shard"]).group_by(["lang", "shard"]).aggregate([]).to_pylist():
        lang, shard = pair["lang"], pair["shard"]
        own = texts.filter(pc.and_(pc.equal(langs, lang), pc.equal(shards, shard)))
        offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset: own.offset + len(own) + 1]
        data = np.frombuffer(own.buffers()[2], np.uint8) if own.buffers()[2] else np.zeros(0, np.uint8)
        at, end = int(offsets[0]), int(offsets[-1])
        while at < end:
            to = min(at + WINDOW_BYTES, end)
            if to < end:  # back to a text's or piece's end, else on to the next one
                text_end = int(offsets[np.searchsorted(offsets, to, "right") - 1])
                if text_end <= at:
                    ends = np.flatnonzero(_CLASS[data[at:to]] == 2)
                    while not len(ends) and to < end:
                        more = min(to + WINDOW_BYTES, int(offsets[np.searchsorted(offsets, to, "right")]))
                        ends = np.flatnonzero(_CLASS[data[to:more]] == 2) + (to - at)
                        if not len(ends) and more == int(offsets[np.searchsorted(offsets, to, "right")]):
                            ends = np.array([more - at - 1])
                        to = more
                    text_end = at + int(ends[-1]) + 1 if len(ends) else to
                to = text_end
            inner = offsets[np.searchsorted(offsets, at, "left"): np.searchsorted(offsets, to, "left")]
            yield lang, shard, data[at:to], inner - at
            at = to


@dataclass
class Words:
    """The words of a window: bytes with one blank after each word, where words begin, hashes, what follows in the same piece."""

    text: np.ndarray
    begin: np.ndarray
    hashes: np.ndarray
    joined: np.ndarray

    def __init__(self, lang: str, data: np.ndarray, text_starts: np.ndarray):
        kind = _CLASS[data]
        inside = kind == 0
        border = np.zeros(len(data) + 1, bool)
        border[text_starts] = True
        first = inside & (~np.concatenate([[False], inside[:-1]]) | border[:-1])
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | border[1:])) + 1
        low = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        sizes = ends - starts
        # words one after the other, a blank after each
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.text = np.full(int(self.begin[-1]), 32, np.uint8)
        word_of = np.cumsum(first) - 1
        byte_at = np.flatnonzero(inside)
        self.text[byte_at + (self.begin[:-1] - starts)[word_of[byte_at]]] = low[byte_at]
        up, down = POWERS.to(len(self.text) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        b, e = self.begin[:-1], self.begin[1:]
        seed = np.uint64(int.from_bytes(lang.encode()[:24], "little") * 0x9E3779B97F4A7C15 % 2**64)
        self.hashes = mix((total[e] - total[b]) * down[b] + seed)
        piece = np.cumsum((kind == 2) | border[:-1])[starts]
        self.joined = piece[1:] == piece[:-1] if len(piece) else np.zeros(0, bool)

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of every phrase of n words."""
        if len(self.hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = np.ones(len(self.hashes) - n + 1, bool)
        for k in range(n - 1):
            ok &= self.joined[k: k + len(ok)]
        at = np.flatnonzero(ok)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h += self.hashes[at + k] * _PLACE[k]
        return at, mix(h + np.uint64(n))

    def strings(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words at these places."""
        begin, end = self.begin[at], self.begin[at + n] - 1
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        take = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.text[take]))


class Bitmap:
    """Hashes that may be in a set: two bits each, taken from the hash, chunks that hold none left out."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.taken = np.uint64(bits.bit_length() - 1)
        self.bytes = np.zeros(bits // 8, np.uint8)
        for i, chunk in chunks.items():
            self.bytes[i * CHUNK_BITS // 8: (i + 1) * CHUNK_BITS // 8] = np.frombuffer(chunk, np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for place in (h >> np.uint64(64) - self.taken, (h << self.taken) >> np.uint64(64) - self.taken):
            found &= (self.bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def shard_bits(shards: int) -> int:
    return max(1, (shards - 1).bit_length())


def in_shard(h: np.ndarray, shard: int, bits: int) -> np.ndarray:
    """The key of a phrase inside one shard: the shard before the upper bits of the hash."""
    return h >> np.uint64(bits) | np.uint64(shard) << np.uint64(64 - bits)


def bitmap_of(keys: DataFrame):
    """A name and the broadcast bitmap of ``h``: about 16 bits a key, at most MOST_BITS in all."""
    wanted = 16 * keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << wanted.bit_length()))
    taken = bits.bit_length() - 1
    places = F.array(F.shiftrightunsigned("h", 64 - taken), F.shiftrightunsigned(F.shiftleft("h", taken), 64 - taken))
    place = keys.select(F.explode(places).alias("place"))
    placed = place.select(F.shiftright("place", CHUNK_BITS.bit_length() - 1).alias("chunk"), (F.col("place") % CHUNK_BITS).alias("bit")).distinct()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(CHUNK_BITS, np.uint8)
        out[rows["bit"].to_numpy().astype(np.int64)] = 1
        return pd.DataFrame({"chunk": rows["chunk"][:1], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    # chunks of 8 KB, MOST_BITS in all
    chunks = placed.groupBy("chunk").applyInPandas(pack, "chunk long, bits binary").collect()
    return uuid.uuid4().hex, keys.sparkSession.sparkContext.broadcast((bits, {r.chunk: bytes(r.bits) for r in chunks}))


_OPENED: dict[str, Bitmap] = {}


def opened(shared: tuple[str, object]) -> Bitmap:
    """A worker's bitmap of a broadcast, made once; that of an earlier pass goes."""
    name, sent = shared
    if name not in _OPENED:
        _OPENED.clear()
        _OPENED[name] = Bitmap(*sent.value)
    return _OPENED[name]


def local_counts(texts: DataFrame, n: int, shards: int, parts=None) -> DataFrame:
    """h, c: occurrences of phrases of n words, by shard, of which both shorter parts may be locally frequent."""
    bits = shard_bits(shards)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = opened(parts) if parts else None
        for batch in batches:
            for lang, shard, data, begins in windows(batch):
                w = Words(lang, data, begins)
                at, h = w.phrases(n)
                if kept:
                    shorter = np.zeros(len(w.hashes) + 1, bool)
                    where, s = w.phrases(n - 1)
                    shorter[where] = kept.holds(in_shard(s, shard, bits))
                    h = h[shorter[at] & shorter[at + 1]]
                keys, c = np.unique(in_shard(h, shard, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return texts.mapInArrow(mine, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Tally:
    """Counts of phrases by language and length, combined as exact strings; given out when they pass HELD_BYTES."""

    def __init__(self) -> None:
        self.found: dict[tuple[str, int], list[pa.Table]] = {}
        self.bytes = 0

    def add(self, lang: str, n: int, phrases: pa.Array, counts: pa.Array) -> None:
        own = pa.table([phrases, counts], ["phrase", "c"])
        self.found.setdefault((lang, n), []).append(own)
        self.bytes += own.nbytes + 1024  # and what a table takes itself

    def combine(self) -> None:
        self.bytes = 0
        for key, own in self.found.items():
            if len(own) > 1:
                own[:] = [pa.concat_tables(own).group_by("phrase", use_threads=False).aggregate([("c", "sum")]).select(["phrase", "c_sum"]).rename_columns(["phrase", "c"])]
            self.bytes += own[0].nbytes + 1024

    def given(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What is held, once it is too much or at the end; nothing while combining makes room for as much again."""
        if not last and self.bytes <= HELD_BYTES:
            return
        self.combine()
        if not last and self.bytes <= HELD_BYTES // 2:
            return
        for (lang, n), own in self.found.items():
            for rows in own[0].to_batches(max_chunksize=GIVEN_ROWS):
                phrase = rows.column(0).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(rows)), phrase, pa.repeat(pa.scalar(n, pa.int32()), len(rows)), rows.column(1)], COUNTED)
        self.found, self.bytes = {}, 0


def exact_counts(texts: DataFrame, longest: int, candidates) -> DataFrame:
    """lang, phrase, words, f: all occurrences of what is in the bitmap; a row of 0 words has a language's number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, tally = opened(candidates), Tally()
        for batch in batches:
            for lang, _, data, begins in windows(batch):
                w = Words(lang, data, begins)
                tally.add(lang, 0, pa.array([""], pa.large_string()), pa.array([len(w.hashes)], pa.int64()))
                for n in range(1, longest + 1):
                    at, h = w.phrases(n)
                    each = w.strings(at[kept.holds(h)], n).value_counts()
                    tally.add(lang, n, each.field("values"), each.field("counts"))
                yield from tally.given()
        yield from tally.given(last=True)

    rows = texts.mapInArrow(count, "lang string, phrase string, words int, c long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f"))


def frequent(docs: DataFrame, rule: Mining = Mining(), lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``longest`` words with the support, and (lang, n) of all words."""
    body = whole_text(F.col(text).cast("string"))
    shard = F.pmod(F.xxhash64(body), F.lit(rule.shards)).cast("int")  # by content, so each pass sees the same shards
    body = whole_text(F.col(text).cast("string"))
    shard = F.pmod(F.xxhash64(body), F.lit(rule.shards)).cast("int")  # by content, so each pass sees the same shards
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"), body.alias("text"))
    parts, union = None, None
    for n in range(1, rule.longest + 1):
        local = local_counts(texts, n, rule.shards, parts).filter(F.col("c") >= rule.local_support()).select("h")
        local = saved(local, f"shards-{n}")
        parts = bitmap_of(local) if n < rule.longest else None
        union = union.unionByName(local) if union else local
    # keys lose their shard; the last bits of a hash aren't looked at by bitmaps, nor does one care for repeated keys
    candidates = union.select(F.shiftleft("h", shard_bits(rule.shards)).alias("h"))
    whole = texts.withColumn("shard", F.lit(0))  # shards have done their work
    counted = exact_counts(whole, rule.longest, bitmap_of(candidates)).filter((F.col("words") == 0) | (F.col("f") >= rule.support))
    counted = saved(counted, "phrases")
    totals = counted.filter("words = 0").select("lang", F.col("f").alias("n"))
    return counted.filter("words > 0"), totals


def exact(count: Column) -> Column:
    return count.cast("decimal(15,0)")


def collocations(docs: DataFrame, rule: Mining = Mining(), lang: str = "lang", text: str = "text") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is cut in two where its score floor(10^6 a^2 / (l r)) is least; phrases that lie in a longer
    candidate with ``cover_percent`` of their count or more are left out. Products are decimals of 38 digits,
    exact up to counts of 10^13.
    """
    known, totals = frequent(docs, rule, lang, text)
    split = known.filter("words > 1").withColumn("_w", F.split("phrase", " ", -1))
    cuts = split.select("lang", "phrase", "words", F.col("f").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("_w", 1, F.col("k")), " ").alias("_l"), F.array_join(F.slice("_w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("_r"))
    for side in ("l", "r"):
        part = known.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(side))
        cuts = cuts.join(part, (F.col("lang") == F.col("_lang")) & (F.col(f"_{side}") == F.col("_part"))).drop("_lang", "_part")
    square = exact(F.col("a")) * exact(F.col("a"))
    score = F.expr("(1000000BD * _square) div _product")
    cuts = cuts.withColumns({"_square": square.cast("decimal(31,0)"), "_product": (exact(F.col("l")) * exact(F.col("r"))).cast("decimal(31,0)")}).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    # the shorter candidates inside a longer one, with the highest count of such
    inner = split.filter("words > 2").select("lang", F.col("f").alias("_f"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("_w", i, m), " "))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("_f").alias("_longer"))
    out = best.join(inner, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < rule.cover_percent * F.col("a")))
    out = out.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    # the best of many slices of a language first, so that no task sorts a whole language
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    out = out.withColumn("_slice", F.pmod(F.hash("phrase"), F.lit(32)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("rank") <= rule.most)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= rule.most)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
