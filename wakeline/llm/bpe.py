"""Byte-level BPE encoding and decoding, by DuckDB recursive queries inside each Spark task.

Each match of the split pattern is encoded separately. A match that is itself a token is that token;
else its bytes are token-position rows, and each round of a recursive query joins neighbouring rows with
the merge table and contracts each match's leftmost pair of minimum rank, until no pair merges. Decoding
joins ids with the vocabulary and aggregates the bytes in the order of their positions.

Equal matches are encoded once: a task numbers the matches that it meets and has the database encode new
ones many at a time. What it has learned lies in flat arrays (ids, their text, decoded bytes), in two
generations bounded by bytes; all of it and the database go when the task ends. Memory: one run of texts (a
million characters, or one longer text), two generations and DuckDB's limit, beyond which a batch of matches
is halved instead of spilled. A match of n bytes takes up to n rounds over n rows.

Defined results: a null or empty text has no ids, and decodes to nothing. Repeated rows are encoded each.
An unpaired surrogate can't occur in a Spark string. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Bytes that a generation of known matches may take (by estimate: 160 and three times its length for a match).
CACHE_BYTES = 48 << 20
#: Characters of text that are matches at one time; characters and new matches after which the database is asked.
RUN_CHARS, HELD_CHARS, HELD_MATCHES = 1_000_000, 8_000_000, 60_000
#: The rank file goes to the executors with the task; larger ones are refused.
MOST_RANK_BYTES = 32 << 20

#: A round turns every word's ids into token-position rows of neighbours; rank and place share one number.
_CONTRACT = """
WITH RECURSIVE step AS (
    SELECT word, ids FROM start
    UNION ALL
    SELECT word, ids[:pos - 1] || [id] || ids[pos + 2:]
    FROM step JOIN (
        SELECT word, (least >> 40)::INT AS id, least & 1099511627775 AS pos
        FROM (
            SELECT p.word, min((m.id::BIGINT << 40) + p.pos) AS least
            FROM (
                SELECT word, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[2:], 1) AS pos
                FROM step WHERE len(ids) > 1
            ) p JOIN merges m ON m.pair = p.a::BIGINT * 2097152 + p.b
            GROUP BY p.word
        )
    ) USING (word)
)
SELECT word, min_by(ids, len(ids)) AS ids FROM step GROUP BY word
"""

_JOINED = "SELECT word, array_to_string(ids, ',') || ',' AS text FROM coded"

_DECODE = """
WITH tokens AS (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded)
SELECT word, unhex(string_agg(hex, '' ORDER BY pos)) AS text FROM tokens JOIN vocabulary USING (id) GROUP BY word
"""


class Flat:
    """Rows of different lengths in one array."""

    def __init__(self, values: np.ndarray, ends: np.ndarray) -> None:
        self.values, self.ends = values, ends

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, rows: np.ndarray) -> "Flat":
        begin, size = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        return Flat(self.values[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)], ends)

    def joined(self, sizes: np.ndarray) -> "Flat":
        """Each ``sizes`` rows as one."""
        return Flat(self.values, self.ends[np.concatenate([[0], np.cumsum(sizes)])])

    def __add__(self, other: "Flat") -> "Flat":
        return Flat(np.concatenate([self.values, other.values]), np.concatenate([self.ends, other.ends[1:] + self.ends[-1]]))


def _flat(column: pa.ChunkedArray) -> Flat:
    """An Arrow column of lists, strings or bytes."""
    kind = pa.large_list(pa.int32()) if pa.types.is_list(column.type) else pa.large_binary()
    rows = column.cast(kind).combine_chunks() if pa.types.is_list(column.type) else column.cast(pa.large_string() if pa.types.is_string(column.type) else kind).combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    if pa.types.is_large_list(rows.type):
        return Flat(rows.flatten().to_numpy(), (o := rows.offsets.to_numpy()) - o[0])
    ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset: rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)
    return Flat(data[ends[0]: ends[-1]], ends - ends[0])


#: For each number of a match: its ids, their decimals with a comma after each, and the bytes they decode to.
NOTHING = {"ids": Flat(np.zeros(0, np.int32), np.zeros(1, np.int64)), **{k: Flat(np.zeros(0, np.uint8), np.zeros(1, np.int64)) for k in ("text", "data")}}


class Coder:
    """One rank file and split pattern in an in-process database, and the matches that it knows."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # no folder to spill to
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "160MB", "temp_directory": ""})
        halves = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        table = np.array(halves, np.int64).reshape(-1, 3)
        self._load("merges", pa.table({"pair": table[:, 0] * 2097152 + table[:, 1], "id": table[:, 2].astype(np.int32)}))
        self._load("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.place: dict[str, int] = {}
        self.known = dict(NOTHING)
        self.older: tuple[dict[str, int], dict[str, Flat]] = {}, dict(NOTHING)
        self.waiting: list[str] = []
        self.bytes = 0

    def close(self) -> None:
        self.db.close()
        self.__dict__.clear()

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _ids(self, matches: list[bytes]) -> pa.Table:
        """word (place in the list) and ids of each match."""
        whole = [i for i, m in enumerate(matches) if m in self.ranks]
        split = [i for i, m in enumerate(matches) if m not in self.ranks]
        found = pa.table({"word": pa.array(whole, pa.int32()), "ids": pa.array([[self.ranks[matches[i]]] for i in whole], pa.list_(pa.int32()))})
        if split:
            ends = np.cumsum([0, *(len(matches[i]) for i in split)])
            data = self.byte_ids[np.frombuffer(b"".join(matches[i] for i in split), np.uint8)]
            start = pa.table({"word": pa.array(split, pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(data))})
            found = pa.concat_tables([found, self._query(_CONTRACT, "start", start).cast(found.schema)])
        return found

    def _learned(self, matches: list[bytes]) -> dict[str, Flat]:
        """What is kept of each match, in their order."""
        try:
            coded = self._ids(matches)
            texts, data = (self._query(sql, "coded", coded).sort_by("word") for sql in (_JOINED, _DECODE))
        except duckdb.OutOfMemoryException:
            if len(matches) < 2:
                raise
            half = len(matches) // 2
            first, second = self._learned(matches[:half]), self._learned(matches[half:])
            return {name: first[name] + second[name] for name in first}
        return {"ids": _flat(coded.sort_by("word").column("ids")), "text": _flat(texts.column("text")), "data": _flat(data.column("text"))}

    def decode(self, coded: pa.Table) -> list[bytes]:
        """Bytes of the ids of each word, in the order of the words' numbers from 0."""
        out = [b""] * coded.num_rows
        found = self._query(_DECODE, "coded", coded)
        for i, text in zip(found.column("word").to_pylist(), found.column("text").to_pylist()):
            out[i] = text
        return out

    def numbers(self, matches: list[str]) -> np.ndarray:
        """The numbers of the matches; those not met before get one now and are learned by ``learn``."""
        place = self.place
        out = [place.get(m, -1) for m in matches]
        if -1 in out:
            for i, number in enumerate(out):
                if number < 0:
                    m = matches[i]
                    number = place.get(m, -1)
                    if number < 0:
                        number = place[m] = len(place)
                        self.waiting.append(m)
                        self.bytes += 160 + 3 * len(m)
                    out[i] = number
        return np.array(out, np.int64)

    def learn(self) -> None:
        """Make ``known`` hold all matches that have a number: from the older generation, or else from the database."""
        if not self.waiting:
            return
        before, rows = self.older
        at = np.array([before.get(m, -1) for m in self.waiting])
        fresh = self._learned([self.waiting[i].encode() for i in np.flatnonzero(at < 0)]) if (at < 0).any() else NOTHING
        # both kinds in the order of their numbers
        order = np.where(at < 0, len(rows["ids"]) + np.cumsum(at < 0) - 1, at)
        self.known = {name: self.known[name] + (rows[name] + fresh[name]).take(order) for name in rows}
        self.waiting = []

    def age(self) -> None:
        """Begin a new generation where the present one is full. Numbers given before are no longer good."""
        if self.bytes > CACHE_BYTES:
            self.older = self.place, self.known
            self.place, self.known, self.bytes = {}, dict(NOTHING), 0


@contextmanager
def _coder(rank_file: bytes, pattern: str) -> Iterator[Coder]:
    """A task's coder; nothing of it stays in the worker, which idles between tasks and stages."""
    coder = Coder(rank_file, pattern)
    try:
        yield coder
    finally:
        coder.close()
        del coder
        gc.collect()
        pa.default_memory_pool().release_unused()


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in runs; nulls are empty. Only one run at a time becomes Python strings."""
    run, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        if run and size + len(text) > RUN_CHARS:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def rank_bytes(path: str) -> bytes:
    """The rank file, read on the driver; its size is checked."""
    with open(path, "rb") as file:
        found = file.read(MOST_RANK_BYTES + 1)
    if len(found) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return found


#: What ``encode`` can return beside doc_id and n_tokens. The digests are SHA-256 in hex, of the comma-joined decimal ids and of the decoded bytes.
OUTPUTS = {"ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def _digests(rows: Flat, less: int) -> pa.Array:
    """SHA-256 of each row without its last ``less`` bytes."""
    data = memoryview(np.ascontiguousarray(rows.values))
    return pa.array([hashlib.sha256(data[b: max(b, e - less)]).hexdigest() for b, e in zip(rows.ends[:-1].tolist(), rows.ends[1:].tolist())], pa.string())


def _outputs(known: dict[str, Flat], numbers: np.ndarray, sizes: np.ndarray, wanted: Sequence[str]) -> dict[str, pa.Array]:
    """n_tokens and the outputs of texts, given the numbers of all their matches and how many each text has."""
    of = lambda name: known[name].take(numbers).joined(sizes)
    made = {
        "ids": lambda: (lambda r: pa.ListArray.from_arrays(pa.array(r.ends, pa.int32()), pa.array(r.values, pa.int32())))(of("ids")),
        "decoded": lambda: (lambda r: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(r), [None, pa.py_buffer(r.ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(r.values))]).cast(pa.binary()))(of("data")),
        "ids_sha256": lambda: _digests(of("text"), 1),
        "decoded_sha256": lambda: _digests(of("data"), 0),
    }
    tokens = np.concatenate([[0], np.cumsum(np.diff(known["ids"].ends)[numbers])])
    return {"n_tokens": pa.array(np.diff(tokens[np.concatenate([[0], np.cumsum(sizes)])]), pa.int64()), **{name: made[name]() for name in wanted}}


def encode(docs: DataFrame, path: str, pattern: str, outputs: Sequence[str] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens and the ``outputs`` (see ``OUTPUTS``) of every text, which is encoded and decoded again."""
    rank_file = rank_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _coder(rank_file, pattern) as coder:
            held, chars = [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                coder.learn()
                for doc_ids, numbers, sizes in held:
                    yield pa.record_batch({"doc_id": doc_ids, **_outputs(coder.known, numbers, sizes, outputs)})
                held.clear()
                coder.age()

            for batch in batches:
                at = 0
                for texts in _runs(batch.column(1)):
                    split = [coder.split(t) for t in texts]
                    sizes = np.array([len(m) for m in split])
                    held.append((batch.column(0).slice(at, len(texts)), coder.numbers([m for row in split for m in row]), sizes))
                    at, chars = at + len(texts), chars + sum(map(len, texts))
                    if chars >= HELD_CHARS or len(coder.waiting) >= HELD_MATCHES:
                        yield from flush()
                        chars = 0
            yield from flush()

    slim = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return slim.mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs))


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``decoded`` bytes of every row of ``coded(doc_id, ids array<int>)``; null ids are none."""
    rank_file = rank_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _coder(rank_file, pattern) as coder:
            for batch in batches:
                rows = pa.table({"word": np.arange(batch.num_rows, dtype=np.int32), "ids": pc.fill_null(batch.column(1), [])})
                yield pa.record_batch({"doc_id": batch.column(0), "decoded": pa.array(coder.decode(rows), pa.binary())})

    return coded.selectExpr("cast(doc_id AS long) AS doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
