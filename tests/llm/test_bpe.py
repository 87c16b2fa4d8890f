import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from wakeline.llm import bpe

from .conftest import odd_texts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def extra():
    return [(900, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (901, "ab" * 700), (902, "   \n\n  x    　"), (903, "<|endoftext|>'s 'LL I'll"), (904, "हिन्दी עברית \U0001F468‍\U0001F469"),
            (905, "\x00\x7f�")]


def test_ids_and_bytes_equal_the_library(spark, odd, library):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra(), "doc_id long, text string"))
    names = list(bpe.OUTPUTS)
    got = sorted((str(r["doc_id"]), r["n_tokens"], tuple(r["ids"]), bytes(r["decoded"]), r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(docs, PATH, P.PATTERN, names).collect())
    want = []
    for d, t in odd_texts() + extra():
        ids = library.encode_ordinary(t or "")
        want.append((str(d), len(ids), tuple(ids), (t or "").encode(), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_decode_is_the_inverse(odd):
    coded = bpe.encode(odd.filter("doc_id < 60"), PATH, P.PATTERN)
    back = bpe.decode(coded.select("doc_id", "ids"), PATH, P.PATTERN)
    want = {d: t for d, t in odd_texts() if d is not None and d < 60}
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == want


def test_null_ids_decode_to_nothing(spark):
    coded = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(coded, PATH, P.PATTERN).collect()] == [b"", b""]


@pytest.mark.parametrize("most", [500, 20_000])
def test_a_full_cache_changes_nothing(library, monkeypatch, most):
    """Two small generations, which come and go, give the ids and bytes of the library."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", most)
    coder = bpe.Coder(bpe.rank_bytes(PATH), P.PATTERN)
    for _, text in odd_texts()[:40]:
        matches = coder.split(text)
        numbers = coder.numbers(matches)
        coder.learn()
        assert coder.known["ids"].take(numbers).values.tolist() == library.encode_ordinary(text)
        assert coder.known["data"].take(numbers).values.tobytes() == text.encode()
        coder.age()
    assert coder.older[0]


def test_too_little_memory_halves_the_batch(library, monkeypatch):
    coder = bpe.Coder(bpe.rank_bytes(PATH), P.PATTERN)
    query = coder._query

    def short(sql, name, rows):
        if rows.num_rows > 3:
            raise bpe.duckdb.OutOfMemoryException("full")
        return query(sql, name, rows)

    monkeypatch.setattr(coder, "_query", short)
    text = odd_texts()[0][1]
    numbers = coder.numbers(coder.split(text))
    coder.learn()
    assert coder.known["ids"].take(numbers).values.tolist() == library.encode_ordinary(text)


def test_empty_table_and_size_check(no_documents, monkeypatch):
    assert bpe.encode(no_documents, PATH, P.PATTERN).count() == 0
    monkeypatch.setattr(bpe, "MOST_RANK_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.rank_bytes(PATH)
