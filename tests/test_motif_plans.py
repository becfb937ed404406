"""What motif plans shuffle: rows of events, not rows of pairs or paths."""

import pytest
from ledgerflow.config import MotifConfig
from ledgerflow.functions import tables
from ledgerflow.operators import communities, edges, features, motifs, significance
from pyspark.sql import functions as F


@pytest.fixture
def events(spark):
    rows = [(i, i % 7, (3 * i + 1) % 11 + 20 * (i % 2), i // 4, float(10 + i % 5), 0) for i in range(80)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.createDataFrame(rows, "event_id long, src_node long, dst_node long, step long, amount double, is_sar int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Join"), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("options", [{}, {"strict_chronology": True}, {"first_edge_only": True}])
def test_split_merge_shuffles_events_alone(events, options):
    joins, exchanges = shuffles(motifs.find_split_merge(events, MotifConfig(**options)))
    assert joins == 1 and exchanges <= 3  # events, legs, and events with their lists of legs


def test_split_merge_tasks_grow_with_the_events(events, spark, monkeypatch):
    rows = [(100 + i, 50 if i % 2 else 60 + i // 2 % 4, 60 + i // 2 % 4 if i % 2 else 70, i // 4, 10.0, 0) for i in range(80)]
    df = spark.createDataFrame(rows, events.schema)  # 50 pays 60 to 63, and they pay 70
    whole = sorted(map(str, motifs.find_split_merge(df).collect()))
    monkeypatch.setattr(tables, "PART_ROWS", 4)
    found = motifs.find_split_merge(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 20), REPARTITION_BY_NUM") == 3 and plan.count("Exchange hashpartitioning") == 3  # events, legs, lists
    assert sorted(map(str, found.collect())) == whole and whole


def test_chains_of_both_types_are_joined_once(events):
    found = motifs.run_all(events, MotifConfig(enabled=("cycle3", "relay4")))
    assert shuffles(found)[0] == 2


def test_filter_reads_instances_once(events):
    found = motifs.run_all(events, MotifConfig(enabled=("relay4", "fanin")))
    plan = significance.filter_motifs(found)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 0  # the matchers aren't in the plan of the filter


def test_filter_deals_no_instances_by_type(events):
    plan = significance.filter_motifs(motifs.run_all(events, MotifConfig(enabled=("relay4", "fanin"))))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # types with enough support are sent to the instances


def test_null_model_writes_no_order_keys(events, spark):
    spark.__dict__["_settled_paths"] = []
    assert significance.shuffle_steps(events, 2).count() == 160
    names = [set(spark.read.parquet(p).columns) for p in spark.__dict__["_settled_paths"]]
    assert {"perm_id", "__step", "__part", "__place"} in names  # digests, sources and event ids gave the order and went
    assert not any("__key" in n for n in names)


def test_entity_features_shuffle_narrow_rows(events, spark):
    x = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**9)) / 10**6
    n, ratio = 20_000, lambda k: F.round(x(k) / 500, 4)
    found = spark.range(0, n, 1, 4).select(F.lit("relay4").alias("motif_type"), F.array("id").alias("nodes"), F.array(x(1), x(2), x(3)).alias("amounts"), F.array(F.lit(1), F.pmod("id", F.lit(3)).cast("int")).alias("lags"), F.array(ratio(4), ratio(5)).alias("ratios"), F.lit(0).alias("n_alert"))
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    before = stages().size()
    assert features.entity_features(found).select(F.sum("count"), F.sum("avg_amount"), F.sum("avg_ratio"), F.sum("ratio_std"), F.sum("avg_lag")).first()[0] == n
    every = stages()  # the latest come first
    written = sum(every.apply(i).shuffleWriteBytes() for i in range(every.size() - before))
    assert written < 55 * n, written / n


def test_null_model_in_batches(events, spark, monkeypatch):
    found = motifs.run_all(events)
    whole = sorted(map(tuple, significance.null_zscore(found, events, n_permutations=5).collect()))
    spark.__dict__["_settled_paths"] = []
    monkeypatch.setattr(significance, "BATCH", 160)  # two permutations of 80 events at a time
    assert sorted(map(tuple, significance.null_zscore(found, events, n_permutations=5).collect())) == whole
    assert len(spark.__dict__["_settled_paths"]) == 1  # the events; tables of batches are gone


def test_relay_tasks_grow_with_the_events(events, monkeypatch):
    whole = sorted(map(tuple, edges.temporal_edges(events).collect()))
    monkeypatch.setattr(tables, "PART_ROWS", 4)
    relay = edges.temporal_edges(events)
    assert relay.rdd.getNumPartitions() == 20  # 4, the session's number, before
    assert sorted(map(tuple, relay.collect())) == whole and whole


def test_counts_within_communities(events, spark):
    rows = events.withColumn("window_id", F.floor(F.col("step") / 7).cast("int"))
    nodes = rows.select("window_id", F.explode(F.array("src_node", "dst_node")).alias("node")).distinct()
    for labels in (F.when(F.col("node") > 40, -1).otherwise(F.col("node") % 2), F.when(F.col("node") == 4, -1).otherwise(0)):
        named = nodes.withColumn("global_cid", labels.cast("bigint"))
        for options in ({}, {"enabled": ("relay4",)}, {"enabled": ("fanin", "split_merge"), "first_edge_only": True}, {"max_instances": 5}):
            cfg = MotifConfig(**options)
            found = communities.motif_counts(motifs.run_all(rows, cfg, ("window_id",)), named, ("window_id",))
            counts = communities.motif_counts_within(rows, named, cfg, ("window_id",))
            order = ("window_id", "global_cid", "motif_count")
            assert sorted(map(tuple, counts.select(*order).collect())) == sorted(map(tuple, found.select(*order).collect()))


def test_relays_of_communities_never_meet_labels(events):
    labels = events.select(F.explode(F.array("src_node", "dst_node")).alias("node")).distinct().withColumn("global_cid", F.lit(0).cast("bigint"))
    counts = communities.motif_counts_within(events, labels, MotifConfig(enabled=("relay4",)))
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 2  # those of the relays: events met the labels before, instances never do
