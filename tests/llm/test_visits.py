"""Visits of anchors to leaves carry no vectors and leave a task in bounded pieces, however many leaves an anchor visits."""

import numpy as np
from pyspark.sql import functions as F

from loomwright.llm import negatives
from loomwright.llm.common import stash


def test_visits_are_pairs_of_numbers_in_bounded_pieces(spark):
    rng = np.random.default_rng(1)
    df = stash(spark.createDataFrame([(i, i % 3, rng.normal(size=8).tolist(), i % 10 == 0) for i in range(600)], "id long, label long, v array<double>, anchor boolean"))
    tree, _, width = negatives.fitted(df, 4, 20, 600, 64)
    rows = negatives.hung(df, tree, width)
    anchors = rows.where("anchor").select("id", "label", "v", F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("most"))
    seen = negatives.visits(anchors, tree, width, False)
    assert seen.columns == ["id", "leaf"] and tree.leaves > 10
    leaves = {r.leaf for r in rows.select("leaf").distinct().collect()}
    pairs = [tuple(r) for r in seen.collect()]
    assert len(set(pairs)) == len(pairs) and set(pairs) >= {(i, k) for i in range(0, 600, 10) for k in leaves}
    assert sorted(pairs) == sorted(tuple(r) for r in negatives.visits(anchors, tree, width, False, most=7).collect())
    assert sorted(tuple(r) for r in negatives.visits(anchors, tree, width, True).collect()) == sorted((r.id, r.leaf) for r in rows.where("anchor").collect())
