"""Audit of k-means centres: sums against numpy, and an unfinished fit shows its defect."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from toposcope.operators.audit import centre_audit


def test_audit_against_numpy_and_an_unfinished_fit(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 1.0, (200, 5)) for c in (0.0, 6.0, 12.0)])
    df = spark.createDataFrame([(row.tolist(),) for row in x] + [(None,), ([1.0, 2.0],)], "v array<double>").repartition(5)
    centres = rng.normal(6.0, 4.0, (3, 5))
    got = {r.cluster: r for r in centre_audit(df, "v", centres).collect()}
    near = ((x[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1)
    for k in range(3):
        own = x[near == k]
        assert got[k].size == len(own) and np.isclose(got[k].cost, ((own - centres[k]) ** 2).sum())
        assert np.isclose(got[k].defect, np.linalg.norm(own.mean(0) - centres[k]))
    features = df.where("size(v) = 5").select(array_to_vector("v").alias("features"))
    early = KMeans(k=3, maxIter=1, seed=1, initMode="random").fit(features)
    done = KMeans(k=3, maxIter=1000, tol=0.0, seed=1).fit(features)
    assert max(r.defect for r in centre_audit(df, "v", np.array(early.clusterCenters())).collect()) > 1e-3
    assert max(r.defect for r in centre_audit(df, "v", np.array(done.clusterCenters())).collect()) <= 1e-9
