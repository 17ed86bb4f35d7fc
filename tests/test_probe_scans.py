"""Probe scans: few products in double precision, few tokens of the texts kept, cheap noise."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.functions import words as W
from tessella.operators import conflicts as CF
from tessella.operators import vectors as VE


def unit(rng, n, dim=48):
    raw = rng.normal(size=(n, dim))
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def test_pairs_far_above_the_threshold_are_not_multiplied_out(monkeypatch):
    rng = np.random.default_rng(3)
    probes, stored = unit(rng, 50), unit(rng, 900)
    stored[7] = probes[4]
    left, right = rng.integers(0, 8, (2, 950))
    hidden = {"s3": [0, 1], "s8": [49]}
    multiplied = []
    monkeypatch.setattr(CF.np, "einsum", lambda how, a, b, einsum=np.einsum: multiplied.append(len(a)) or einsum(how, a, b))
    for t, tile in ((0.1, 2048), (0.1, 7), (0.95, 16)):
        monkeypatch.setattr(CF, "PROBE_TILE", tile)
        multiplied.clear()
        sums = CF._ProbeSums(np.array([f"p{i}" for i in range(50)], object), probes, left[:50], right[:50], hidden, t, 0.85)
        for first in range(0, 900, 300):
            at = slice(first, first + 300)
            sums.add([f"s{i}" for i in range(900)][at], stored[at], left[50:][at], right[50:][at])
        product = probes @ stored.T
        product[[0, 1, 49], [3, 3, 8]] = -np.inf
        hits = (product >= t).sum(axis=1)
        got = sums.frame().set_index("id")
        assert got["n_conflicts"].to_dict() == {f"p{i}": n for i, n in enumerate(hits) if n}
        for i in np.flatnonzero(hits):
            assert abs(got["max_similarity"][f"p{i}"] - product[i].max()) < 1e-12
        assert sum(multiplied) <= 3 * 50 + 5  # about one a probe and batch
    assert int(hits.sum()) == 1 and got["n_opposed"].sum() == int(sums.opposed[4])


def test_noise_vectors_share_one_generator(spark, monkeypatch):
    made = []
    monkeypatch.setattr(VE.np.random, "RandomState", lambda *a, make=np.random.RandomState: made.append(a) or make(*a))
    texts = pd.Series([f"text {i}" for i in range(20)])
    got = np.stack(list(next(VE.fallback_embedder("conflict", 9).func(iter([texts])))))
    assert len(made) <= 1
    monkeypatch.undo()
    raw = np.stack([np.random.RandomState(VE.md5_seed(t)).randn(9) for t in texts])
    assert (got == raw / np.array([np.linalg.norm(x) for x in raw])[:, None]).all()


def test_antonyms_in_a_text_are_all_that_sides_need(spark):
    texts = ["Buy, buy SELL no", "yes up up DOWN on", "", None, "İ none Always\x1fnever", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    sides = lambda ws: [W.antonym_sides(ws, side) for side in (0, 1)]
    got = df.select(W.antonyms_in(F.col("t")).alias("ws")).select(*sides(F.col("ws"))).collect()
    assert got == df.select(W.word_set(F.col("t")).alias("ws")).select(*sides(F.col("ws"))).collect()
    assert got[0] != got[5]


def test_blocks_of_probes_leave_no_broadcast(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    gone = []
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, destroy=Broadcast.destroy: gone.append(1) or destroy(self, *a))
    vec = unit(np.random.default_rng(1), 12, 3)
    rows = spark.createDataFrame([(f"r{i}", v.tolist(), [i % 2], [0]) for i, v in enumerate(vec)], "id string, vec array<double>, left array<int>, right array<int>")
    want = {f"r{i}": n for i, n in enumerate((vec @ vec.T >= 0.5).sum(axis=1) - 1) if n}
    for size, blocks in ((100, 0), (5, 3)):
        monkeypatch.setattr(CF, "PROBE_ROWS", size)
        assert {r["id"]: r["n_conflicts"] for r in CF.scan_probes(rows, rows, 0.5).collect()} == want
        assert len(gone) == blocks
