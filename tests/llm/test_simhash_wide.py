"""The bound that spares members of one hub a look at each other."""

import numpy as np
from corvane.llm import simhash_wide as wide
from pyspark.sql import functions as F


def test_members_of_a_hub_meet_only_where_they_can_be_similar(spark):
    """The bound lets every similar pair through, whatever the hub, and of near copies below the similarity hardly any."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    hub, pool = draw(150), draw(12)
    sets = [np.unique(np.concatenate([rng.permutation(hub)[: 150 - d], draw(d // 2), rng.permutation(pool)[: d % 4]])) for d in map(int, rng.integers(4, 22, 90))]
    far = draw(40)  # members that share next to nothing with the hub, and empty sets
    sets += [np.unique(np.append(far[k:], hub[:k])) for k in range(6)] + [draw(0), draw(0), np.unique(draw(3000))]
    sets += [np.union1d(sets[-1], draw(20)), np.unique(hub)]
    made = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "node long, hashes binary")
    last = len(sets) - 1
    spokes = wide.spokes_of(spark.range(len(sets)).select(F.col("id").alias("a"), F.lit(last).cast("long").alias("b")), made).cache()
    met = spokes.alias("q").join(spokes.alias("t"), F.expr(f"q.a < t.a AND {wide._possible(0.8 - 1e-9)}")).select("q.a", "t.a").collect()
    met = {tuple(r) for r in met}
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if wide.similarity_of(sets[a], sets[b]) >= 0.8}
    assert len(similar) > 100 and similar <= met
    assert len(met) < 1.2 * len(similar)
