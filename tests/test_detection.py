import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import sequential as detection

from ledgerflow.config import CommunityConfig
from ledgerflow.operators import detection as on_tables
from ledgerflow.streaming import flows

GRAPH = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.floats(0.1, 10)), min_size=1, max_size=60)


@settings(max_examples=40, deadline=None)
@given(GRAPH)
def test_better_than_singletons_and_repeatable(rows):
    i, j, w = (np.array(x) for x in zip(*rows, strict=True))
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    a, b = detection.cluster(i, j, w), detection.cluster(i, j, w)
    assert (a == b).all() and len(a) == len(nodes)
    assert detection.modularity(i, j, w, a) >= detection.modularity(i, j, w, np.arange(len(nodes))) - 1e-9


def planted(spark, groups=3, size=8):
    rng = random.Random(1)
    rows = [(0, g * size + a, g * size + b, 10.0) for g in range(groups) for a in range(size) for b in range(size) if a != b and rng.random() < 0.7]
    rows += [(0, g * size, (g + 1) % groups * size, 0.5) for g in range(groups)]
    return spark.createDataFrame(rows, "window_id int, i long, j long, w double")


def test_planted_groups(spark):
    for method in ("leiden", "infomap"):
        got = {}
        for r in on_tables.detect_communities(planted(spark), CommunityConfig(method=method)).collect():
            got.setdefault(r.community_id, set()).add(r.node // 8)
        assert len(got) == 3 and all(len(x) == 1 for x in got.values())


def better_codes(label, i, j, p, flow):
    """Code lengths after every merge of two linked communities and every move of a node to a linked community."""
    pairs = {(a, b) for a, b in zip(label[i].tolist(), label[j].tolist(), strict=True) if a != b}
    for a, b in pairs:
        yield detection._code_length(np.unique(np.where(label == b, a, label), return_inverse=True)[1], i, j, p, flow)
    for u, v in {*zip(i.tolist(), j.tolist(), strict=True), *zip(j.tolist(), i.tolist(), strict=True)}:
        if label[u] != label[v]:
            trial = label.copy()
            trial[u] = label[v]
            yield detection._code_length(np.unique(trial, return_inverse=True)[1], i, j, p, flow)


def test_no_merge_or_move_shortens_the_code():
    rng = np.random.default_rng(3)
    ring = np.arange(200)
    for i, j in ((ring, (ring + 1) % 200), (rng.integers(0, 150, 450), rng.integers(0, 150, 450))):
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        i, j = at[: len(i)], at[len(i) :]
        w = np.ones(len(i))
        p, flow = detection._flow(len(nodes), i, j, w)
        label = detection.map_equation(i, j, w)
        assert min(better_codes(label, i, j, p, flow)) >= detection._code_length(label, i, j, p, flow) - 1e-9


def test_merges_go_on_past_ten():
    """30 linked triangles from single nodes: 60 merges."""
    t = np.arange(90)
    i = np.concatenate([t, t[::3]])
    j = np.concatenate([t // 3 * 3 + (t + 1) % 3, (t[::3] + 3) % 90])
    w = np.concatenate([np.full(90, 10.0), np.full(30, 0.1)])
    p, flow = detection._flow(90, i, j, w)
    assert detection._merged(t, i, j, p, flow).tolist() == (t // 3).tolist()


def random_windows(spark):
    """Two windows of groups with noise, a null window among them, and the arrays of each."""
    rng, rows, arrays = np.random.default_rng(5), [], {}
    for window in (0, None):
        group = rng.integers(0, 5, 70)
        i, j = rng.integers(0, 70, 900), rng.integers(0, 70, 900)
        keep = (group[i] == group[j]) | (rng.random(900) < 0.15)
        pairs = sorted({(int(a), int(b)) for a, b in zip(i[keep], j[keep], strict=True)})
        w = rng.random(len(pairs)) + 0.1
        rows += [(window, a, b, float(x)) for (a, b), x in zip(pairs, w, strict=True)]
        nodes, at = np.unique(np.array(pairs).ravel(order="F"), return_inverse=True)
        arrays[window] = (nodes, at[: len(pairs)], at[len(pairs) :], w)
    return spark.createDataFrame([*rows, (0, 500, 501, 0.0), (0, 501, 500, -1.0)], "window_id int, i long, j long, w double").repartition(3), arrays


def test_leiden_on_tables_is_as_good_as_node_by_node(spark):
    """Every node once, communities connected, modularity as good as the sequential version's, the same labels again."""
    matrix, arrays = random_windows(spark)
    cfg = CommunityConfig(min_comm_size=1)
    labels = on_tables.detect_communities(matrix, cfg).cache()
    got: dict = {}
    for r in labels.collect():
        assert got.setdefault(r.window_id, {}).setdefault(r.node, r.community_id) == r.community_id
    assert {k: sorted(v) for k, v in got.items()} == {k: x[0].tolist() for k, x in arrays.items()}
    scores = {r.window_id: r.q for r in on_tables.modularity(matrix.where("window_id is not null"), labels).collect()}
    for window, (nodes, i, j, w) in arrays.items():
        label = np.array([got[window][n] for n in nodes.tolist()])
        ours, theirs = detection.modularity(i, j, w, label), detection.modularity(i, j, w, detection.cluster(i, j, w))
        assert ours >= theirs - 0.01
        if window is not None:
            assert abs(scores[window] - ours) < 1e-9
        sizes = np.bincount(label)
        assert (np.diff(sizes) <= 0).all()  # the largest first
    assert on_tables.connected_parts(matrix, labels).where("parts > 1").count() == 0
    again = on_tables.detect_communities(matrix.repartition(5), cfg)
    assert again.exceptAll(labels).count() == 0


def test_no_window_is_one_task(spark):
    """The plan of a round has no window, group map or Python in it."""
    matrix, _ = random_windows(spark)
    g = on_tables._graph(matrix.withColumnRenamed("window_id", "k").where("w > 0"))
    plan = on_tables._round(g, on_tables._alone(g), 1.0, "true", "q")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan


def test_map_equation_on_tables(spark):
    """The code of the labels is no longer than that of single nodes or one community, and nearly that of the sequential
    version; visit rates are those of the walk."""
    rng = np.random.default_rng(8)
    group = np.arange(60) // 10
    pairs = [(a, b) for a in range(60) for b in range(60) if a != b and rng.random() < (0.5 if group[a] == group[b] else 0.01)]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    w = np.ones(len(i))
    matrix = spark.createDataFrame([(0, int(a), int(b), 1.0) for a, b in pairs], "window_id int, i long, j long, w double")
    got = {r.node: r.community_id for r in on_tables.detect_communities(matrix, CommunityConfig(method="infomap", min_comm_size=1)).collect()}
    label = np.unique([got[n] for n in range(60)], return_inverse=True)[1]
    p, flow = detection._flow(60, i, j, w)
    assert detection._code_length(label, i, j, p, flow) <= 1.01 * detection._code_length(detection.map_equation(i, j, w), i, j, p, flow)
    g = on_tables._graph(matrix.withColumnRenamed("window_id", "k"))
    rates = {r.u: r.p / on_tables.UNIT for r in on_tables.visit_rates(g).collect()}
    assert max(abs(rates[n] - p[n]) for n in range(60)) < 1e-3


def test_split_depths(spark):
    """Large communities come apart, the others keep their nodes, and an empty matrix has no labels."""
    matrix = planted(spark)
    whole = on_tables.detect_communities(matrix, CommunityConfig(resolution=1e-4, min_comm_size=2))
    assert whole.select("community_id").distinct().count() == 1
    parts = on_tables.split_large_communities(matrix, CommunityConfig(resolution=1e-4, resolution_multiplier=1e4, s_max=10, min_comm_size=2, max_recursion_depth=1))
    got: dict = {}
    for r in parts.collect():
        got.setdefault(r.community_id, set()).add(r.node // 8)
    assert len(got) == 3 and all(len(x) == 1 for x in got.values())
    assert on_tables.detect_communities(matrix.where("false")).count() == 0
    assert on_tables.detect_communities(matrix, CommunityConfig(method="trivial"), keys=()).select("community_id").distinct().count() == 1


def test_split_keeps_noise(spark):
    labels = on_tables.split_large_communities(planted(spark), CommunityConfig(s_max=4, min_comm_size=2, resolution=0.01))
    assert labels.count() == 24


def test_streams(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS ts, id AS src_node, id + 1 AS dst_node, 10.0 AS amount FROM range(4)")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, out, mode in (("relay", flows.relay_stream(stream), "append"), ("snap", flows.snapshot_stream(stream, "2 days", "1 day"), "update")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("relay").count() == 3 and spark.table("snap").count() == 8
