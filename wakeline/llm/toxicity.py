"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary and on toxic text. A window of words is compressed
with the ordinary dictionary and with the toxic one laid before the ordinary one, so that the lengths
differ by what toxic text explains better. Toxic samples keep the words that are ``word_ratio`` times
commoner in toxic documents than in ordinary ones; else frequent ordinary words fill the dictionary. The
margins of all windows of a whole text give a few numbers, and a logistic curve turns them into a
calibrated score. The curve is fitted crosswise: each half of the labelled sample is measured with
dictionaries of the other half.

Bounds (documented parameters): the sample is the ``toxic_sample`` and ``plain_sample`` labelled documents
lowest in a hash of doc_id; those of at most ``sample_chars`` characters serve the dictionaries, texts of
any length the curve. Every text is scored whole.

Defined results: a null or empty text is one empty window. A doc_id with labels of both classes counts as not
toxic. Labels that are null, or of documents without a row, are ignored; without labels of both classes every score is the share of toxic labels (0 without
labels). Repeated rows get equal scores. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wakeline.session import saved


@dataclass(frozen=True)
class Toxicity:
    window_words: int = 5
    level: int = 12
    toxic_bytes: int = 2048
    plain_bytes: int = 110_000
    toxic_sample: int = 2000
    plain_sample: int = 4000
    sample_chars: int = 8000
    #: A word belongs to the toxic samples if at least this share of them hold it, and so many times the share of ordinary ones.
    word_share: float = 0.02
    word_ratio: float = 10.0
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    plain: bytes
    toxic: bytes
    weights: tuple[float, ...]
    prior: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _words(text: str) -> list[str]:
    return [w.strip(".,;:!?\"'()") for w in text.lower().split()]


def _windows(text: str, n: int) -> list[bytes]:
    w = text.lower().split()
    return [f" {' '.join(w[i:i + n])} ".encode() for i in range(0, len(w), n)] or [b""]


def _trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """A trained dictionary; too few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionaries(toxic: list[str], plain: list[str], p: Toxicity) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    toxic_words, plain_words = ([[w for w in _words(text) if w] for text in texts] for texts in (toxic, plain))
    in_toxic, in_plain = (Counter(w for words in texts for w in set(words)) for texts in (toxic_words, plain_words))
    least, scale = max(2, p.word_share * len(toxic)), p.word_ratio * (len(toxic) + 1) / (len(plain) + 1)
    telling = {w for w, n in in_toxic.items() if n >= least and n + 0.5 >= scale * (in_plain[w] + 0.5)}
    own = [[w for w in words if w in telling] for words in toxic_words]
    # a sample holds about 24 words, a short document's words over again
    samples = [f" {' '.join(words[i:i + 24] * max(1, 24 // max(1, len(words))))} ".encode() for words in own for i in range(0, len(words), 24)]
    return (_trained([w for text in plain for w in _windows(text, p.window_words)], p.plain_bytes),
            _trained(samples, p.toxic_bytes, k=48, d=6))


def _measure(plain: bytes, toxic: bytes, p: Toxicity):
    """The margins of a text's windows as numbers for the curve."""
    def packer(content: bytes):
        if not content:
            return zstandard.ZstdCompressor(level=p.level, write_content_size=False).compress
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=p.level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    with_plain, with_toxic = packer(plain), packer(toxic + plain)

    def measure(text: str) -> tuple[float, ...]:
        margins = np.array([len(with_plain(w)) - len(with_toxic(w)) for w in _windows(text, p.window_words)])
        top = np.sort(margins)[::-1][:3]
        return (1.0, float(top[0]), float(top.mean()), float(margins.mean()), float((margins >= 4).mean() ** 0.5), float(np.log(len(margins))))

    return measure


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, without held-out rows."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model(b"", b"", (), prior)
    lot = F.xxhash64("doc_id")
    parts = [known.filter(F.col("toxic") == c).orderBy(lot, "doc_id").limit(n) for c, n in ((1, p.toxic_sample), (0, p.plain_sample))]
    chosen = parts[0].unionByName(parts[1])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # broadcast: at most toxic_sample + plain_sample rows of two numbers
    sample = saved(slim.join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")), "toxicity")
    rows = sample.filter(F.length("text") <= p.sample_chars).orderBy("doc_id").select("toxic", "text", "half").collect()
    texts = lambda c, halves: [r["text"] for r in rows if r["toxic"] == c and r["half"] in halves]
    pairs = [dictionaries(texts(1, halves), texts(0, halves), p) for halves in ((0,), (1,), (0, 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_other = [_measure(*pairs[1], p), _measure(*pairs[0], p)]
        for batch in batches:
            found = [by_other[half](t.as_py()) for t, half in zip(batch.column(1), batch.column(3).to_pylist())]
            yield pa.record_batch({"doc_id": batch.column(0), "toxic": batch.column(2), "x": pa.array(found, pa.list_(pa.float64()))})

    fitted = sample.select("doc_id", "text", "toxic", "half").mapInArrow(run, "doc_id long, toxic int, x array<double>").orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in fitted], float)
    if not 0 < y.sum() < len(y):
        return Model(*pairs[2], (), prior)
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum())) * len(y)
    return Model(*pairs[2], _fit(np.array([r["x"] for r in fitted]), y, weight), prior)


def _scorer(model: Model, p: Toxicity):
    """Scores of an Arrow column of texts."""
    measure, w = _measure(model.plain, model.toxic, p), np.array(model.weights)

    def found(texts: pa.Array) -> pa.Array:
        if not len(w):
            return pa.array(np.full(len(texts), model.prior))
        x = np.array([measure(t.as_py() or "") for t in texts]).reshape(-1, len(w))
        return pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return found


def score(docs: DataFrame, model: Model, p: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model, p)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "score": scores(batch.column(1))})

    slim = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    scored = slim.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """The documents that aren't predicted toxic, each row by its own text; rows pass through with all their columns, so nothing is joined."""
    model, names = train(docs, labels, p), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model, p)
        for batch in batches:
            keep = pc.less(scores(batch.column(batch.num_columns - 1)), p.threshold)
            yield batch.filter(keep).select(names)

    # columns by place, as their names are the caller's; the text once more as a string
    plain = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)], F.col("text").cast("string").alias("text"))
    kept = plain.mapInArrow(run, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)]))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
