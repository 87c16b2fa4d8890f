import re
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import near_dedup as N
from wakeline.llm.common import mix

from .conftest import UPPER, odd_texts


def brute(rows, k):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i)), d == least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k", [4, 5])
def test_groups_equal_brute_force(odd, k):
    got = N.near_groups(odd, N.NearDedup(k=k)).collect()
    assert Counter(tuple(r) for r in got) == brute(odd_texts(), k)


def test_large_bucket_is_resolved_in_blocks(spark):
    # neighbours in a chain are similar, the ends are not; without pivots the blocks must find every link
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[2 * i: 2 * i + 100])) for i in range(60)] + [(100 + i, " ".join(words[:90] + [f"u{i}_{j}" for j in range(30)])) for i in range(40)]
    for rounds in (0, 1):
        got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), N.NearDedup(k=2, pivot_rounds=rounds, block=8)).collect()
        assert Counter(tuple(r) for r in got) == brute(rows, 2)


def test_empty_table_and_drop(no_documents, odd):
    assert N.near_groups(no_documents).count() == 0
    left = N.drop_near_copies(odd)
    assert left.columns == odd.columns
    gone = {r.doc_id for r in N.near_groups(odd).collect() if not r.kept and r.doc_id is not None}
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in odd_texts() if d not in gone)


def test_signatures_are_super_minhash():
    """Level by level equals the definition: each element's permutation ranks, the least for each slot."""
    slots = 24
    sets = [np.sort(mix(np.arange(a, b, dtype=np.uint64))) for a, b in ((0, 5), (0, 300), (50, 350), (7, 8))]
    got = N.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), slots)
    for row, s in zip(got, sets):
        want = np.full(slots, 2**64 - 1, np.uint64)
        for e in s:
            order = list(range(slots))
            for level in range(slots):
                rank = int(mix(np.array([e + N._salt(2 * level + 1)]))[0]) >> 8 | level << 56
                pick = level + (int(mix(np.array([e + N._salt(2 * level + 2)]))[0]) >> 32) % (slots - level)
                order[level], order[pick] = order[pick], order[level]
                want[order[level]] = min(int(want[order[level]]), rank)
        assert (row == want).all()
    assert abs((got[1] == got[2]).mean() - 250 / 350) < 0.35
