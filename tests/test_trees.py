"""Tree forecasts against a plain walk over the exported trees, on every scored row."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wakeline.operators import features as FE
from wakeline.operators import models as M
from wakeline.operators import splits as SP
from wakeline.plans import adapter as A

SF = "/root/testdata/sf0.001"
CUT = "2024-01-01 08:00:00"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables are not here")


def exported(node):
    """A tree as nested tuples: a number, or (feature, threshold, gain, rows, left, right)."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), node.gain(), node.impurityStats().count(), exported(node.leftChild()), exported(node.rightChild())


def walk(tree, x):
    while isinstance(tree, tuple):
        tree = tree[4] if x[tree[0]] <= tree[1] else tree[5]
    return tree


def trees(model):
    return [exported(t._java_obj.rootNode()) for t in model.trees]


def gains(tree, found):
    if isinstance(tree, tuple):
        found[tree[0]] = found.get(tree[0], 0.0) + tree[2] * tree[3]
        for side in tree[4:]:
            gains(side, found)
    return found


@pytest.fixture(scope="module")
def matrix(spark):
    return SP.by_cut_date(FE.design_matrix(A.segments(spark, SF), ("lat", "lon"), horizons=(1, 3)), "time", CUT, 1).cache()


@pytest.fixture(scope="module")
def forest(matrix):
    return M.fit_forest(matrix.filter("split = 'train'"), trees=5, depth=4)


def test_forest_forecasts_equal_a_walk_over_its_trees(matrix, forest):
    names = M._features(("lat", "lon"))
    rows = M.apply_forest(forest, matrix.filter("split <> 'train'")).collect()
    assert len(rows) > 50
    for (h, c), model in forest.items():
        own = trees(model)
        assert len(own) == 5 and any(isinstance(t, tuple) for t in own)
        for r in rows:
            change = sum(walk(t, [r[n] for n in names]) for t in own) / len(own)
            assert r[f"pred_{c}_t{h}"] == pytest.approx(change, abs=1e-12)
            assert r[f"pred_{c}_h{h}"] == pytest.approx(r[c] + change, abs=1e-12)


def test_importances_are_gains_summed_over_nodes(forest):
    names = M._features(("lat", "lon"))
    got = {(h, c, n): v for h, c, n, v in M.importances(forest)}
    for (h, c), model in forest.items():
        total = dict.fromkeys(range(len(names)), 0.0)
        for tree in trees(model):
            found = gains(tree, {})
            for i, gain in found.items():
                total[i] += gain / sum(found.values())
        whole = sum(total.values())
        for i, n in enumerate(names):
            assert got[h, c, n] == pytest.approx(total[i] / whole, abs=1e-9)


def test_rolled_forecasts_walk_step_by_step(spark, forest):
    """Each predicted position joins the history that the next step is predicted from."""
    import numpy as np

    names = M._features(("lat", "lon"))
    seq = FE.sequences(A.segments(spark, SF), 10, 0, keys=("mmsi", "segment_id"))
    states = seq.select("sample_id", F.transform("input", lambda p: p["lat"]).alias("hist_lat"), F.transform("input", lambda p: p["lon"]).alias("hist_lon"))
    want, own = {}, {c: trees(forest[1, c]) for c in ("lat", "lon")}
    for r in states.collect():
        hist = {c: list(r[f"hist_{c}"]) for c in own}
        for step in (1, 2, 3):
            x = {}
            for c, h in hist.items():
                x |= {c: h[-1], f"{c}_lag1": h[-2], f"{c}_lag2": h[-3], f"{c}_lag3": h[-4], f"{c}_diff": h[-1] - h[-2]}
                for k in (3, 5, 10):
                    x |= {f"{c}_mean{k}": np.mean(h[-k:]), f"{c}_std{k}": np.std(h[-k:])}
            for c in own:
                hist[c] = [*hist[c], x[c] + sum(walk(t, [x[n] for n in names]) for t in own[c]) / len(own[c])][-10:]
            want[r.sample_id, step] = (hist["lat"][-1], hist["lon"][-1])
    got = {(r.sample_id, r.step): (r.pred_lat, r.pred_lon) for r in M.roll_forest({k: m for k, m in forest.items() if k[0] == 1}, states, 3).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    # a value on a threshold may fall to either side by its last bit, so a few rows may take another leaf
    off = [k for k in want if got[k] != pytest.approx(want[k], abs=1e-9)]
    assert len(off) <= len(want) // 100


def test_boosted_forecasts_equal_a_walk_over_their_trees(spark):
    seq = SP.by_cut_date(FE.sequences(A.segments(spark, SF), 6, 2, keys=("mmsi", "segment_id")), "start_time", CUT, 1)
    models = M.fit_boosted(seq.filter("split = 'train'"), (1, 2), rounds=4, depth=3)
    rows = M.apply_boosted(models, seq.filter("split <> 'train'")).collect()
    assert len(rows) > 10
    for (s, c), model in models.items():
        own = list(zip(model.treeWeights, trees(model)))
        for r in rows:
            x = [p[n] for p in r.input for n in ("lat", "lon", "cog")]
            assert r[f"pred_{c}_{s}"] == pytest.approx(sum(w * walk(t, x) for w, t in own), abs=1e-9)
