"""Support by counting against the instances that the matchers make."""

import numpy as np
import pytest
from ledgerflow.config import MotifConfig
from ledgerflow.operators import counting, motifs, significance


def events(spark, n=900, nodes=12, steps=60, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(int(p), int(i), int(a), int(b), float(x), int(t)) for p in (0, 4) for i, (a, b, x, t) in enumerate(zip(rng.integers(0, nodes, n), rng.integers(0, nodes, n), rng.choice([0.0, 1.0, 1.5, 2.0, 3.0, 4.5], n), rng.integers(-3, steps, n), strict=True))]
    return spark.createDataFrame(rows, "perm_id int, event_id long, src_node long, dst_node long, amount double, step int").repartition(3)


def both(df, cfg):
    assert counting.countable(df, cfg)
    want = {(r.perm_id, r.motif_type): r.support for r in significance.count_support(motifs.run_all(df, cfg, ("perm_id",)), ("perm_id",)).collect()}
    return {(r.perm_id, r.motif_type): r.support for r in counting.count_motifs(df, cfg, "perm_id").collect()}, want


@pytest.mark.parametrize("cfg", [MotifConfig(), MotifConfig(delta=1, r_min_fanin=4, r_min_fanout=2, strict_chronology=True, rho_min=0.4), MotifConfig(delta=2, enabled=("relay4", "split_merge"), max_instances=700)])
def test_counts_are_those_of_the_instances(spark, cfg):
    """Self-loops, equal amounts, no amount, steps under 0, nodes whose rows are many batches."""
    df = events(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    got, want = both(df, cfg)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(want) == 2 * len(cfg.enabled)


def test_groups_and_ranges_are_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(counting, "ROWS", 5)
    monkeypatch.setattr(counting, "PAIRS", 4)
    key = np.repeat(np.arange(7), [1, 9, 2, 1, 1, 12, 3])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 2]), pa.array(key[a : a + 2]), pa.array(key[a : a + 2])], ["a", "b", "c"]) for a in range(0, len(key), 2)]
    found = [cols[0].tolist() for cols in counting._groups(iter(batches))]
    assert sum(found, []) == key.tolist() and len(found) > 2 and all(x[-1] != y[0] for x, y in zip(found[:-1], found[1:], strict=True))
    low, high = np.array([0, 5, 2, 9]), np.array([3, 5, 11, 8])
    assert [(i, j) for a, b in counting._ranges(low, high) for i, j in zip(a.tolist(), b.tolist(), strict=True)] == [(i, j) for i in range(4) for j in range(low[i], high[i])]


def test_the_null_model_makes_no_instances(spark, monkeypatch):
    df = events(spark).where("perm_id = 0 and src_node <> dst_node and amount > 0").drop("perm_id")
    found = motifs.run_all(df)
    monkeypatch.setattr(counting, "countable", None)
    monkeypatch.setattr(significance, "countable", lambda df, cfg: False)
    want = sorted(map(tuple, significance.null_zscore(found, df, n_permutations=3).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(significance, "run_all", None)
    assert sorted(map(tuple, significance.null_zscore(found, df, n_permutations=3).collect())) == want


def test_what_is_not_counted(spark):
    df = events(spark, 50)
    assert not counting.countable(df, MotifConfig(dedup_fanin=True)) and not counting.countable(df, MotifConfig(first_edge_only=True))
    assert not counting.countable(df.withColumn("step", motifs.F.expr("nullif(step, 3)")), MotifConfig())
