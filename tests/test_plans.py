"""Plans, options, hubs and clustering quality on small tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import sequential as detection

from ledgerflow.config import CommunityConfig, GraphConfig, MotifConfig
from ledgerflow.functions import tables
from ledgerflow.operators import detection as on_tables
from ledgerflow.operators import motifs, significance, windows
from ledgerflow.plans import pipelines
from ledgerflow.sources import sinks, transactions


@pytest.fixture(scope="module")
def hub(spark):
    """A hub with most events of 80 steps, ties and repeated amounts among them."""
    rng = random.Random(4)
    rows = []
    for k in range(420):
        a, b = rng.randrange(1, 9), rng.randrange(1, 9)
        a, b = ((0, b), (a, 0), (a, b))[rng.randrange(3)]
        if a != b:
            rows.append((k, a, b, float(rng.choice((10, 12, 15, 30))), rng.randrange(-20, 60), k % 7 == 0))
    return rows, spark.createDataFrame([(*r[:5], int(r[5])) for r in rows], "event_id long, src_node long, dst_node long, amount double, step int, is_sar int").repartition(3).cache()


def follows(a, b, delta=3):
    return b[1] == a[2] and 0 < b[4] - a[4] <= delta and 0.5 <= b[3] / a[3] <= 2


def edges_of(df):
    return sorted(tuple(r.edges) for r in df.collect())


def test_chains_through_a_hub(hub):
    rows, df = hub
    pairs = [(a, b) for a in rows for b in rows if follows(a, b) and b[2] not in (a[1], a[2])]
    three = [(a, b, c) for a, b in pairs for c in rows if follows(b, c)]
    assert edges_of(motifs.find_cycle3(df)) == sorted((a[0], b[0], c[0]) for a, b, c in three if c[2] == a[1])
    assert edges_of(motifs.find_relay4(df)) == sorted((a[0], b[0], c[0]) for a, b, c in three if c[2] not in (a[1], a[2], b[2]))


def test_cycles_with_and_without_hubs(hub, monkeypatch):
    """Both ways to meet give the same rows, keys and self-loops included."""
    rows, df = hub
    df = df.unionByName(df.where("event_id % 9 = 0").selectExpr("event_id + 1000 AS event_id", "src_node", "src_node AS dst_node", "amount", "step", "is_sar")).withColumn("w", F.col("event_id") % 2)
    for keys in ((), ("w",)):
        got = []
        for most in (10**9, 0):
            monkeypatch.setattr(motifs, "HUB", most)
            got.append(sorted(map(str, motifs.find_cycle3(df, keys=keys).collect())))
        assert got[0] == got[1] and got[0]


def test_pairs_of_cycles_at_a_hub(spark, monkeypatch):
    """300 nodes pay a hub and 300 are paid by it within one reach: 90,000 pairs at the hub, a few at the others."""
    rows = [(k, 1000 + k, 0, 10.0, 1, 0) for k in range(300)] + [(300 + k, 0, 2000 + k, 10.0, 2, 0) for k in range(300)]
    rows += [(600 + k, 2000 + k, 1000 + k, 10.0, 3, 0) for k in range(0, 300, 10)]
    df = spark.createDataFrame(rows, "event_id long, src_node long, dst_node long, amount double, step int, is_sar int")
    monkeypatch.setattr(motifs, "HUB", 100)
    pairs = sum(x.count() for x in motifs.cycle_pairs(df))
    assert edges_of(motifs.find_cycle3(df)) == sorted((k, 300 + k, 600 + k) for k in range(0, 300, 10))
    assert pairs < 200


def test_fans_of_a_hub(hub):
    rows, df = hub
    for find, centre, far in ((motifs.find_fanin, 2, 1), (motifs.find_fanout, 1, 2)):
        want = []
        for seed in rows:
            group = [seed]
            for e in sorted((e for e in rows if e[centre] == seed[centre] and (e[4], e[0]) > (seed[4], seed[0]) and e[4] - seed[4] <= 3), key=lambda e: (e[4], e[0])):
                if e[far] not in {g[far] for g in group} and 0.5 <= e[3] / group[-1][3] <= 2:
                    group.append(e)
            if len(group) >= 3:
                want.append(tuple(e[0] for e in group))
        assert edges_of(find(df)) == sorted(want)


def test_split_merge_of_a_hub(hub):
    rows, df = hub
    fits = lambda x, y: 0.5 <= y[3] / x[3] <= 2
    want = []
    for p in rows:
        for q in rows:
            if q[1] != p[1] or not ((q[4], q[0]) > (p[4], p[0])) or q[4] - p[4] > 3 or q[2] in (p[1], p[2]) or not fits(p, q):
                continue
            leg = lambda first, e: e[1] == first[2] and 0 < e[4] - p[4] <= 6 and fits(first, e) and e[2] not in (p[1], p[2], q[2])  # noqa: B023, E731
            for r in (e for e in rows if leg(p, e)):
                want += [tuple(x[0] for _, _, x in sorted((x[4], k, x) for k, x in enumerate((p, q, r, s)))) for s in rows if leg(q, s) and s[2] == r[2]]
    assert edges_of(motifs.find_split_merge(df)) == sorted(want)


def test_numbered_has_no_gaps(spark):
    df = spark.range(5000).selectExpr("id % 977 AS a", "CAST(id AS STRING) AS b").repartition(7)
    got = tables.numbered(df, ("a", "b"), "n", 10).collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(10, 5010))
    assert tables.numbered(df.where("a < 0"), ("a",), "n").count() == 0


def test_reports_keep_every_row(spark, tmp_path):
    path = sinks.save_report(spark.range(1500).selectExpr("id", "id * 2 AS twice"), f"file://{tmp_path}/report")
    assert len(json.loads(spark.read.text(path).first()[0])) == 1500


def test_motif_plan_saves(spark, hub, tmp_path):
    _, df = hub
    result = pipelines.motif_pipeline(df, MotifConfig(n_permutations=2, r_min_cycle=10**6), with_zscores=True)
    paths = result.save(f"file://{tmp_path}/out")
    report = json.loads(spark.read.text(paths["motif_support"]).first()[0])
    assert set(report) == {"raw_support", "filtered_support", "zscore_table"} and "cycle3" in report["raw_support"] and "cycle3" not in report["filtered_support"]
    assert set(report["zscore_table"]["relay4"]) == {"observed", "null_mean", "null_std", "zscore"}
    saved = spark.read.parquet(paths["motif_instances"])
    assert saved.count() == sum(report["filtered_support"].values()) and "window_start" in saved.columns


def test_null_model_options(hub):
    _, df = hub
    found = motifs.run_all(df)
    full = {r.motif_type: r for r in significance.null_zscore(found, df, n_permutations=3).collect()}
    capped = {r.motif_type: r for r in significance.null_zscore(found, df, n_permutations=3, null_cap=5).collect()}
    assert all(capped[t].null_mean == min(5, capped[t].null_mean) and capped[t].observed == r.observed for t, r in full.items())
    some = {r.motif_type: r for r in significance.null_zscore(found, df, n_permutations=3, sample_frac=0.3).collect()}
    assert all(some[t].null_mean <= r.null_mean for t, r in full.items())
    assert significance.null_zscore(found.where("motif_type = 'none'"), df, n_permutations=2, observed_only=True).count() == 0


def test_first_window_alone(hub):
    _, df = hub
    cfg = GraphConfig(window_size=15, window_stride=5)
    both = [sorted(map(tuple, pipelines.graph_pipeline(df, cfg, w).snapshot_edges.where("window_id = 0").collect())) for w in (True, False)]
    assert both[0] and both[0] == both[1]
    assert {r.window_id for r in pipelines.graph_pipeline(df, cfg, False).snapshot_edges.collect()} == {0}


def test_ordered_ids(spark):
    good = spark.createDataFrame([(0, 1), (1, 1), (2, 5)], "event_id long, step int")
    assert transactions.check_ordered(good).count() == 3
    with pytest.raises(ValueError):
        transactions.check_ordered(spark.createDataFrame([(0, 5), (1, 1)], "event_id long, step int"))


def test_gappy_and_missing_rows(spark):
    assert windows.assign_windows(spark.createDataFrame([], "step int"), 3, 2).count() == 0


def graphs():
    rng = np.random.default_rng(7)
    for _ in range(12):
        group = rng.integers(0, 6, 60)
        i, j = rng.integers(0, 60, 900), rng.integers(0, 60, 900)
        keep = (i != j) & ((group[i] == group[j]) | (rng.random(900) < 0.15))
        nodes, at = np.unique(np.concatenate([i[keep], j[keep]]), return_inverse=True)
        n = keep.sum()
        yield at[:n], at[n:], rng.random(n) + 0.1


def test_refinement_keeps_quality():
    """Leiden is no worse than moves and contraction alone, its communities hang together, and refined ones do too."""
    better = []
    for i, j, w in graphs():
        label = detection.cluster(i, j, w)
        links: dict = {}
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
        assert all(len(detection._pieces(np.flatnonzero(label == c).tolist(), links)) == 1 for c in np.unique(label))
        plain = detection.multilevel(i, j, w)
        better.append(detection.modularity(i, j, w, label) - detection.modularity(i, j, w, plain))
        greedy = detection.greedy_modularity(i, j, w)
        assert detection.modularity(i, j, w, greedy) > 0.2
    assert np.mean(better) > -0.002


def test_every_method(spark):
    rows = [(0, g * 6 + a, g * 6 + b, 5.0) for g in range(3) for a in range(6) for b in range(6) if a != b] + [(0, 0, 6, 0.1), (0, 6, 12, 0.1)]
    matrix = spark.createDataFrame(rows, "window_id int, i long, j long, w double")
    for method in ("leiden", "infomap", "multilevel", "greedy"):
        got: dict = {}
        for r in on_tables.detect_communities(matrix, CommunityConfig(method=method)).collect():
            got.setdefault(r.community_id, set()).add(r.node // 6)
        assert sorted(map(len, got.values())) == [1, 1, 1], method
    assert {r.community_id for r in on_tables.detect_communities(matrix, CommunityConfig(method="trivial")).collect()} == {0}


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e15, 1e35])
def test_features_of_large_amounts(spark, scale):
    rows = [(k, a, b, scale * (1 + k / 10), k, 0) for k, (a, b) in enumerate([(1, 2), (2, 3), (3, 4), (4, 5)])]
    df = spark.createDataFrame(rows, "event_id long, src_node long, dst_node long, amount double, step int, is_sar int")
    got = {(r.node, r.motif_type): r for r in pipelines.motif_pipeline(df).entity.collect()}
    first, second = (sum(x[3] for x in rows[k : k + 3]) / 3 for k in (0, 1))
    assert got[1, "relay4"].avg_amount == pytest.approx(first, rel=1e-12)
    assert got[2, "relay4"].avg_amount == pytest.approx((first + second) / 2, rel=1e-12) and got[2, "relay4"]["count"] == 2


def test_reports_refuse_to_lose_rows(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    with pytest.raises(ValueError, match="several rows"):
        sinks.save_report(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), path)
    with pytest.raises(ValueError, match="more than 3"):
        sinks.save_report(spark.range(4).withColumn("v", F.lit(1)), path, most=3)
    assert not (tmp_path / "report").exists()


def test_events_are_dealt_to_all_cores_and_cleared(spark, hub):
    _, df = hub
    kept = tables.settled(df.coalesce(1), "src_node", "step")
    assert len(kept.inputFiles()) == tables.cores(spark) and kept.count() == df.count()
    assert tables.clear(spark) >= 1 and tables.clear(spark) == 0
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        kept.count()
