"""LOF of one column over range partitions with the rows around them, against joins by id."""

import numpy as np
import pytest

from strata.operators import outliers as O


def scores(df, id_col="id"):
    return dict(map(tuple, df.collect()))


@pytest.mark.parametrize("k", [None, 5])
def test_lof_over_many_partitions(spark, k):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=6000).round(2), np.full(2500, 0.5), [40.0, -7.0], rng.exponential(size=500)])
    rows = [(int(i), None if i % 50 == 0 else float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    lof = O.lof_scores_1d(df, "v", "id", k)
    assert lof.rdd.getNumPartitions() > 3 and "explode" not in lof._jdf.queryExecution().toString()
    med = float(np.median([x for _, x in rows if x is not None]))
    want = scores(O._lof_of_ids(df.na.fill({"v": med}), "id", k or 20))
    got = scores(lof)
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), rtol=1e-9)


def test_lof_of_few_rows_and_of_shared_ids(spark):
    few = spark.createDataFrame([(i, float(i * i)) for i in range(4)], "id long, v double")
    got, want = scores(O.lof_scores_1d(few, "v", "id", 9)), scores(O._lof_of_ids(few, "id", 9))
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()))
    twice = few.unionByName(few)
    assert sorted(scores(O.lof_scores_1d(twice, "v", "id", 3))) == [0, 1, 2, 3]
    assert O.lof_scores_1d(few.limit(1), "v", "id").count() == 0
