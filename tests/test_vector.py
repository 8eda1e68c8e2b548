import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.operators import search, validate

ODD = [
    (1, [1.0] + [0.0] * 63), (2, [2.0] + [0.0] * 63), (3, [0.0] * 64), (4, [math.nan] + [1.0] * 63), (5, [math.inf] + [1.0] * 63),
    (6, None), (7, [1.0] * 63), (8, [-1.0] + [0.0] * 63), (9, [0.0, 3.0] + [0.0] * 62), (10, [None] + [1.0] * 63), (11, []),
]
SCHEMA = "global_id long, embedding array<float>"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_usable(odd):
    assert sorted(r.global_id for r in odd.where(V.usable("embedding")).collect()) == [1, 2, 8, 9]


def test_cosine_policy(spark):
    rows = [(1, [1.0, 0.0], [2.0, 0.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, [1.0], [1.0, 0.0]), (5, [1.0, 0.0], [0.0, -5.0])]
    d = spark.createDataFrame(rows, "i int, a array<float>, b array<float>").select("i", V.cosine("a", "b").alias("c"))
    assert {r.i: r.c for r in d.collect()} == {1: 1.0, 2: 0.0, 3: None, 4: None, 5: 0.0}


def test_normalise_and_stretch(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [5.0, 5.0])], "i int, v array<float>")
    got = {r.i: (r.n, r.s) for r in d.select("i", V.normalise("v").alias("n"), V.stretch("v").alias("s")).collect()}
    assert got[1][0] == pytest.approx([0.6, 0.8]) and got[2] == ([0.0, 0.0], [0.0, 0.0])
    assert got[1][1] == pytest.approx([0.0, 1.0]) and got[3][1] == [0.0, 0.0]


def test_health_counts_each_fault(odd):
    h = validate.health(odd).first()
    assert (h.n, h.n_null, h.n_length, h.n_non_finite, h.n_zero, h.min_norm) == (11, 1, 2, 3, 4, 0.0)


def test_batch_equals_numpy_at_any_partitioning(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 64)).astype(np.float32)
    x[7] = x[3]
    d = spark.createDataFrame([(i, [float(f) for f in r]) for i, r in enumerate(x)], SCHEMA)
    q = d.where("global_id < 9").select(F.col("global_id").alias("query_id"), "embedding")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u[:9] @ u.T, 6)
    want = {(i, r + 1, int(j)) for i in range(9) for r, j in enumerate(np.lexsort((np.arange(120), -s[i]))[:5])}
    for n in (1, 4, 7):
        got = search.batch_top(d.repartition(n), q, 5)
        assert {(r.query_id, r.rank, r.global_id) for r in got.collect()} == want


def test_batch_refuses_too_many_and_takes_none(spark, odd):
    with pytest.raises(ValueError):
        search.batch_top(odd, odd.select(F.col("global_id").alias("query_id"), "embedding"), 3, most=4)
    assert search.batch_top(odd, odd.where("false").select(F.col("global_id").alias("query_id"), "embedding"), 3).count() == 0
