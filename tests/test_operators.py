"""Hand-made cases: motifs, windows, loading, weighting, features, scores, tracking."""

import random
import types

import pytest
from pyspark.sql import functions as F

from ledgerflow import queries
from ledgerflow.config import CommunityConfig, MotifConfig
from ledgerflow.operators import communities, edges, encoding, motifs, significance, tracking, windows
from ledgerflow.plans import pipelines
from ledgerflow.sources import sinks, transactions

EVENTS = "step int, src_node long, dst_node long, amount double, is_sar int, event_id long"


def events(spark, *rows):
    return spark.createDataFrame([(*r, *([0] if len(r) == 4 else []), i) for i, r in enumerate(rows)], EVENTS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_fanin(spark):
    df = events(spark, (1, 1, 99, 100.0), (2, 2, 99, 90.0), (3, 3, 99, 110.0, 1))
    r = one(motifs.find_fanin(df))
    assert (r.nodes, r.edges, r.lags, r.ratios, r.n_alert) == ([1, 2, 3, 99], [0, 1, 2], [1, 1], [0.9, 1.2222], 1)
    assert motifs.find_fanin(df.where("step < 3")).count() == 0


def test_fanout(spark):
    r = one(motifs.find_fanout(events(spark, (1, 10, 21, 200.0), (2, 10, 22, 190.0), (3, 10, 23, 210.0))))
    assert (r.nodes, r.ratios) == ([10, 21, 22, 23], [0.95, 1.1053])


def test_greedy_compares_with_the_last_accepted(spark):
    df = events(spark, (1, 1, 9, 100.0), (1, 2, 9, 30.0), (1, 3, 9, 60.0), (1, 4, 9, 110.0))
    assert sorted(len(r.edges) for r in motifs.find_fanin(df).collect()) == [3, 3]


def test_cycle(spark):
    df = events(spark, (1, 1, 2, 100.0), (2, 2, 3, 95.0), (3, 3, 1, 90.0, 1))
    r = one(motifs.find_cycle3(df))
    assert (r.nodes, r.ratios, r.n_alert) == ([1, 2, 3, 1], [0.95, 0.9474], 1)
    assert motifs.find_cycle3(df, MotifConfig(delta=0)).count() == 0


def test_relay(spark):
    df = events(spark, (1, 1, 2, 500.0), (2, 2, 3, 480.0), (3, 3, 4, 460.0))
    assert one(motifs.find_relay4(df)).ratios == [0.96, 0.9583]
    assert windows.filter_window(df, 1, 2).count() == 2
    assert motifs.find_relay4(events(spark, (1, 1, 2, 1000.0), (2, 2, 3, 1.0), (3, 3, 4, 1.0))).count() == 0


def test_split_merge(spark):
    r = one(motifs.find_split_merge(events(spark, (1, 10, 21, 200.0), (1, 10, 22, 200.0), (3, 21, 99, 190.0), (3, 22, 99, 185.0))))
    assert (r.nodes, r.steps, r.lags, r.ratios) == ([10, 21, 22, 99], [1, 1, 3, 3], [0, 2, 0], [1.0, 0.95, 0.9737])


def test_all_motifs_of_nothing(spark):
    found = motifs.run_all(events(spark).where("false"))
    assert found.columns == list(motifs.COLUMNS) and found.count() == 0


def test_windows(spark):
    df = spark.range(10).select(F.col("id").cast("int").alias("step"))
    got = lambda size, stride: [tuple(r) for r in windows.assign_windows(df, size, stride).groupBy("step_start", "step_end").count().orderBy("step_start").collect()]
    assert got(4, 3) == [(0, 3, 4), (3, 6, 4), (6, 9, 4), (9, 12, 1)]
    assert got(2, 5) == [(0, 1, 2), (5, 6, 2)]


def test_loading(spark):
    raw = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 0.0, 1), (1, 2, -1.0, 1), (1, 2, None, 1), (None, 2, 3.0, 1), (1, 2, float("nan"), 1), (1, 2, 7.0, 1)], "nameOrig long, nameDest long, amount double, step int")
    r = one(transactions.normalize(raw))
    assert (r.src_node, r.dst_node, r.amount, r.step, r.is_sar) == (1, 2, 7.0, 1, 0)
    with pytest.raises(ValueError, match="mandatory"):
        transactions.normalize(raw.drop("amount"))
    with pytest.raises(ValueError, match="timestamp"):
        transactions.normalize(raw.drop("step"))


def test_text_labels_pass(spark):
    raw = spark.createDataFrame([("a", "1", "5.5", 1), ("b", "2", "6", 2)], "src_node string, dst_node string, amount string, step int")
    out = transactions.normalize(raw)
    assert dict(out.dtypes) == {"src_node": "string", "dst_node": "bigint", "amount": "float", "step": "int", "is_sar": "tinyint"}


def test_elapsed_days(spark):
    df = spark.sql("SELECT explode(array(timestamp'2024-01-01 10:00:00', timestamp'2024-01-02 09:00:00', timestamp'2024-01-02 11:00:00')) AS timestamp")
    assert sorted(r.step for r in transactions.with_step(df).collect()) == [0, 0, 1]


def test_files(spark, tmp_path):
    df = events(spark, (1, 1, 2, 10.0), (2, 2, 3, 20.0)).drop("event_id")
    csv = sinks.save_table(df, "t", str(tmp_path), "csv")
    parquet = sinks.save_table(df, "t.parquet", str(tmp_path))
    for path in (csv, parquet):
        assert transactions.load_transactions(spark, path).count() == 2
    assert sinks.save_all({"a": df, "b": df.where("false")}, str(tmp_path)) == {"a": f"{tmp_path}/a"}
    assert spark.read.text(sinks.save_report(df.select("step", "amount"), f"{tmp_path}/r")).first()[0].startswith('{"1"')


def test_encoder(spark):
    df = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C"), ("C", "A")], "src_node string, dst_node string")
    coded, names = encoding.fit_transform(df)
    assert {r.raw_id: r.node_id for r in names.collect()} == {"A": 0, "B": 1, "C": 2}
    grown = encoding.fit(spark.createDataFrame([("D", "AA")], "src_node string, dst_node string"), known=names)
    assert {r.raw_id: r.node_id for r in grown.collect()} == {"A": 0, "B": 1, "C": 2, "AA": 3, "D": 4}
    back = encoding.decode(encoding.decode(coded, names, "src_node"), names, "dst_node")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(KeyError):
        encoding.transform(spark.createDataFrame([("Z", "A")], df.schema), names)


def test_second_order(spark):
    relay = edges.temporal_edges(events(spark, (1, 0, 1, 100.0), (2, 1, 2, 200.0, 1), (3, 2, 3, 300.0)))
    assert sorted((r.src_1, r.dst_2) for r in relay.collect()) == [(0, 2), (1, 3)]
    assert sorted(map(tuple, edges.second_order_edges(relay).collect())) == [(0, 2, 1, 100.0, 200.0, 1.0, 1), (1, 3, 1, 200.0, 300.0, 1.0, 1)]


def test_weighting(spark):
    df = spark.createDataFrame([(1, 2, 100.0), (1, 3, 50.0), (2, 3, 50.0)], "src_node long, dst_node long, weight double")
    got = {(r.src_node, r.dst_node): round(r.weight, 3) for r in communities.apply_weighting(df).collect()}
    assert got == {(1, 2): 66.667, (1, 3): 33.333, (2, 3): 25.0}


def test_roles(spark):
    df = events(spark, (0, 0, 1, 100.0), (0, 0, 2, 200.0), (0, 1, 2, 150.0, 1), (0, 2, 3, 50.0))
    got = {r.node: (r.role, r.n_alert_tx) for r in communities.node_roles(df).collect()}
    assert (got[0][0], got[2][0], got[3][0], got[1][1], got[2][1]) == (1, 2, 2, 1, 1)


def test_community_features(spark):
    df = events(spark, (0, 1, 2, 100.0), (0, 2, 1, 60.0), (0, 2, 3, 40.0), (0, 3, 4, 50.0), (0, 4, 5, 30.0), (0, 5, 6, 70.0))
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, -1)], "node long, global_cid long")
    a, b = communities.community_features(df, labels).orderBy("global_cid").collect()
    assert [round(x, 6) for x in (a.internal_flow, a.external_flow, a.reciprocity, a.sink_concentration, a.source_concentration, a.edge_density, a.vol_density)] == [0.714286, 0.178571, 0.8, 0.5, 0.5, 0.5, 66.666667]
    assert [round(x, 6) for x in (b.internal_flow, b.external_flow, b.reciprocity, b.edge_density, b.vol_density)] == [0.107143, 0.0, 0.0, 0.5, 15.0]


def test_scores(spark):
    rows = [(0, 5, 0.6, 0.5, 2.0, 0.1), (1, 10, 0.3, 0.1, 0.0, 0.4), (2, 3, 0.1, 0.0, 0.5, 0.5)]
    f = spark.createDataFrame(rows, "global_cid long, size long, internal_flow double, reciprocity double, motif_enrichment double, external_noise double").withColumn("persistence", F.lit(0.0))
    seen = spark.createDataFrame([(0, 2), (1, 1)], "global_cid long, n_windows long")
    got = {r.global_cid: r for r in communities.score_communities(f, persistence=seen, max_windows=2).collect()}
    assert [round(got[i].suspicion_score, 6) for i in range(3)] == [0.580412, 0.075105, 0.0]
    assert [got[i].is_suspicious for i in range(3)] == [1, 0, 0]
    assert (got[0].flag_internal_flow, got[0].flag_reciprocity, got[0].flag_persistence, got[0].flag_motif) == (1, 1, 1, 1)


LABELS = "window_id int, node long, community_id long"


def track(spark, *windows_):
    rows = [(w, n, c) for w, groups in enumerate(windows_) for c, nodes in groups.items() for n in nodes]
    return {(r.window_id, r.node): r.global_cid for r in tracking.track(spark.createDataFrame(rows, LABELS)).collect()}


def test_tracking(spark):
    assert track(spark, {0: [0, 1], 1: [2, 3]}) == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (0, 3): 1}
    got = track(spark, {0: [0, 1, 2]}, {0: [0, 1, 2], 1: [3]})
    assert (got[1, 0], got[1, 3]) == (0, 1)
    got = track(spark, {0: [1, 2, 3, 4]}, {0: [1, 2], 1: [3, 4, 5], -1: [9]})
    assert (got[1, 1], got[1, 3], got[1, 9]) == (0, 1, -1)


def plain_track(rows, thresh=0.25, memory=3):
    """(window, node) to (id, size, overlap), window after window."""
    out, buffer, counter = {}, [], 0
    for w in sorted({r[0] for r in rows}):
        own, latest = {}, {}
        for _, n, c in (r for r in rows if r[0] == w and r[2] != -1):
            own.setdefault(c, set()).add(n)
        for named in buffer:
            for g, nodes in named.items():
                latest.update(dict.fromkeys(nodes, g))
        past: dict = {}
        for n, g in latest.items():
            past.setdefault(g, set()).add(n)
        claims: dict = {}
        for c, nodes in own.items():
            fits = [(-len(nodes & x) / len(nodes | x), g) for g, x in past.items() if nodes & x and len(nodes & x) / len(nodes | x) >= thresh]
            if fits:
                claims.setdefault(min(fits)[1], []).append((min(fits)[0], c))
        ids = {min(x)[1]: g for g, x in claims.items()}
        for c in sorted(own):
            if c not in ids:
                ids[c], counter = counter, counter + 1
        before = buffer[-1] if buffer else {}
        for _, n, c in (r for r in rows if r[0] == w):
            over = max((len(own[c] & x) / len(own[c] | x) for x in before.values()), default=0.0) if c != -1 else 0.0
            out[w, n] = (ids[c], len(own[c]), round(over, 4)) if c != -1 else (-1, 0, 0.0)
        buffer = [*buffer, {ids[c]: x for c, x in own.items()}][-memory:]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tracking_of_conflicting_labels(spark, seed):
    """Communities that claim one past one, come apart, come back after a gap, and windows of noise alone."""
    rng = random.Random(seed)
    groups, rows = {n: n // 6 for n in range(48)}, []
    for w in range(0, 18, 2):
        for n in range(48):
            if rng.random() < 0.25:
                groups[n] = rng.randrange(8)
            if rng.random() < 0.8:
                rows.append((w, n, -1 if w == 8 or rng.random() < 0.1 else groups[n] * 3))
    got = {(r.window_id, r.node): (r.global_cid, r.community_size, r.overlap_score) for r in tracking.track(spark.createDataFrame(rows, LABELS).repartition(4)).collect()}
    assert got == plain_track(rows)
    assert len({v[0] for v in got.values()}) > 10


def test_tracking_of_nothing(spark):
    nothing = spark.createDataFrame([], LABELS)
    assert tracking.track(nothing).count() == 0 and tracking.track(nothing).columns == ["window_id", "node", "global_cid", "community_size", "overlap_score"]
    assert [r.global_cid for r in tracking.track(spark.createDataFrame([(3, 1, -1)], LABELS)).collect()] == [-1]


def test_tracking_jobs_do_not_grow_with_windows(spark):
    jobs = {}
    for windows_ in (6, 24):
        df = spark.createDataFrame([(w, n, n // 5) for w in range(windows_) for n in range(20)], LABELS).cache()
        df.count()
        spark.sparkContext.setJobGroup(f"track-{windows_}", "")
        assert tracking.track(df).count() == 20 * windows_
        jobs[windows_] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"track-{windows_}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[24] < jobs[6] * 1.6


def test_shuffle_keeps_each_source_steps(spark):
    df = events(spark, *[(s, s % 3, 9, 1.0) for s in range(12)])
    out = significance.shuffle_steps(df, 2)
    steps = lambda d: sorted((r.src_node, r.step) for r in d.collect())
    assert steps(out.where("perm_id = 0")) == steps(df) == steps(out.where("perm_id = 1"))


def test_zscore_of_real_support(spark):
    """The query's rows hold real support, and z follows from 30 permutations of the default seed."""
    df = events(spark, *[(k % 4, k % 5, (k * 3 + 1) % 7, 10.0) for k in range(40) if k % 5 != (k * 3 + 1) % 7])
    found = motifs.run_all(df)
    seen = {r.motif_type: r.support for r in significance.count_support(found).collect()}
    nulls = {}
    for r in significance.count_support(motifs.run_all(significance.shuffle_steps(df, 30), keys=("perm_id",)), ("perm_id",)).collect():
        nulls.setdefault(r.motif_type, []).append(r.support)
    rows = significance.null_zscore(found, df).collect()
    assert len(rows) == 5 and sum(r.observed for r in rows) == sum(seen.values()) > 0
    for r in rows:
        x = nulls.get(r.motif_type, [])
        x += [0] * (30 - len(x))
        mean = sum(x) / 30
        std = (sum((v - mean) ** 2 for v in x) / 30) ** 0.5
        assert r.observed == seen.get(r.motif_type, 0) and abs(r.zscore - (r.observed - mean) / (std + 1e-9)) < 1e-2 + 1e-6 * abs(r.zscore)


def test_full_pipeline_counts_all_types(spark, sf_dir, monkeypatch):
    seen = {}
    monkeypatch.setattr(pipelines, "community_pipeline", lambda ev, **kw: seen.update(kw) or types.SimpleNamespace(features=ev))
    queries.queries()["full_pipeline"](spark, sf_dir)
    assert {r.motif_type for r in seen["found"].select("motif_type").distinct().collect()} == set(motifs.MATCHERS)


def test_all_types_enrich(spark, tmp_path):
    """Few nodes in two communities: instances of every type count, as in DuckDB."""
    import duckdb

    rng = random.Random(5)
    rows = [(k, rng.choice([0, 20, 40, 60, 80, 1, 21, 41]), rng.uniform(10.0, 15.0), "click") for k in range(260)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, value double, event_type string")
    # twelve events a day, so that windows hold several days
    made.selectExpr("event_id", "user_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(CAST(event_id DIV 12 AS INT), 0, CAST(event_id % 12 AS INT)) AS ts", "value", "event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    total = {}
    for name in ("motif_enrichment", "motif_enrichment_all"):
        got = sorted(tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).select("window_id", "global_cid", "motif_enrichment").collect())
        want = sorted(con.execute(f"SELECT window_id, global_cid, motif_enrichment FROM ({queries.oracle_sql()[name]})").fetchall())
        assert [r[:2] for r in got] == [r[:2] for r in want] and got
        assert all(abs(a[2] - b[2]) < 2e-4 for a, b in zip(got, want, strict=True))
        total[name] = sum(r[2] for r in got)
    assert total["motif_enrichment_all"] > total["motif_enrichment"] > 0
