"""Temporal motifs: fan-in, fan-out, three-node cycle, four-node relay, split-merge.

Chains are joins on a node with a bounded lag, written in time order.  Fans are greedy folds over the short list of
events that follow a seed within delta steps.  Both work on stretches of time: a row that an earlier stretch can reach is
there as well, so a node with very many events is many small groups, and every pair still meets once.  Every instance is
a row of MOTIF columns; `keys` (a window or a permutation number) are carried through, so all windows run in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MotifConfig
from ..functions.tables import parts, settled

#: Length of a stretch of time, in reaches: one row in so many is there twice.
STRETCH = 8

#: A node with more events than that is a hub: then edges of cycles meet in the node of the cycle with the fewest events.
HUB = 10_000

COLUMNS = ("motif_type", "nodes", "edges", "steps", "amounts", "lags", "ratios", "n_alert")


def _ratio_ok(before: Column, after: Column, cfg: MotifConfig) -> Column:
    return (before > 0) & (after / before).between(cfg.rho_min, cfg.rho_max)


def _event(prefix: str) -> Column:
    """An event of a joined row as a struct."""
    return F.struct(*(F.col(f"{prefix}_{c}").alias(c) for c in ("step", "event_id", "amount", "alert")))


def _named(df: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    """The event table under prefixed names, so that joins of it with itself are plain."""
    alert = F.col("is_sar") if "is_sar" in df.columns else F.lit(0)
    cols = {"src": F.col("src_node"), "dst": F.col("dst_node"), "step": F.col("step"), "event_id": F.col("event_id"), "amount": F.col("amount").cast("double"), "alert": alert.cast("int")}
    return df.select(*(F.col(k).alias(f"{prefix}_{k}") for k in keys), *(c.alias(f"{prefix}_{n}") for n, c in cols.items()))


def _stretch(step: Column, reach: int) -> Column:
    return F.floor(step / F.lit(STRETCH * max(reach, 1)))


def _stretches(step: Column, reach: int) -> Column:
    """The stretches from which a row at `step` is at most `reach` steps away: its own, and maybe the one before."""
    own = _stretch(step, reach)
    return F.when(F.pmod(step, F.lit(STRETCH * max(reach, 1))) < reach, F.array(own - 1, own)).otherwise(F.array(own))


def _reached(df: DataFrame, prefix: str, reach: int) -> DataFrame:
    """df, a named event table, with a row for each stretch that reaches it."""
    return df.withColumn(f"{prefix}_stretch", F.explode(_stretches(F.col(f"{prefix}_step"), reach)))


def instances(df: DataFrame, motif_type: str | Column, nodes: Column, events: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """MOTIF rows of an array of event structs in order: lags, and ratios of consecutive amounts rounded to 4 places."""
    kind = F.lit(motif_type) if isinstance(motif_type, str) else motif_type
    rows = df.select(*keys, kind.alias("motif_type"), nodes.alias("nodes"), events.alias("e"))
    e = F.col("e")
    later = F.slice(e, F.lit(2), F.size(e) - 1)
    earlier = F.slice(e, F.lit(1), F.size(e) - 1)
    ratio = lambda a, b: F.when(a["amount"] > 0, F.round(b["amount"] / a["amount"], 4)).otherwise(F.lit(0.0))
    return rows.select(
        *keys, "motif_type", "nodes", e["event_id"].alias("edges"), e["step"].alias("steps"), e["amount"].alias("amounts"),
        F.zip_with(earlier, later, lambda a, b: b["step"] - a["step"]).alias("lags"), F.zip_with(earlier, later, ratio).alias("ratios"),
        F.aggregate(e, F.lit(0), lambda s, x: s + x["alert"]).alias("n_alert"),
    )


def _fan(df: DataFrame, centre: str, other: str, least: int, cfg: MotifConfig, keys: tuple[str, ...]) -> DataFrame:
    """key columns, centre, group (events in order of acceptance), others (their far ends).

    Each event is a seed.  Later events of its centre, in order of (step, event_id) and at most delta steps after the
    seed, are accepted if their far end is new and their amount fits that of the last accepted one.
    """
    alert = F.col("is_sar") if "is_sar" in df.columns else F.lit(0)
    # another row of the centre can only be a seed's fellow if enough far ends lie in its reach
    reach = Window.partitionBy(*keys, centre, "__stretch").orderBy("step").rangeBetween(0, cfg.delta)
    event = F.struct(F.col("step"), F.col("event_id"), F.col(other).alias("far"), F.col("amount").cast("double").alias("amount"), alert.cast("int").alias("alert"))
    df = df.withColumn("__stretch", F.explode(_stretches(F.col("step"), cfg.delta)))
    own = F.col("__stretch") == _stretch(F.col("step"), cfg.delta)  # only there it is a seed
    rows = df.select(*keys, F.col(centre).alias("centre"), event.alias("seed"), own.alias("own"), F.collect_list(event).over(reach).alias("c"), F.count("*").over(reach).alias("n"))
    rows = rows.where(F.col("own") & (F.col("n") >= least) & (F.size(F.array_distinct(F.col("c")["far"])) >= least))
    seed = F.col("seed")
    after = lambda x: (x["step"] > seed["step"]) | ((x["step"] == seed["step"]) & (x["event_id"] > seed["event_id"]))
    rows = rows.withColumn("c", F.sort_array(F.filter("c", after)))
    start = F.struct(F.array(seed).alias("g"), F.array(seed["far"]).alias("s"), seed["amount"].alias("a"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct(F.concat(acc["g"], F.array(x)).alias("g"), F.concat(acc["s"], F.array(x["far"])).alias("s"), x["amount"].alias("a"))
        return F.when(~F.array_contains(acc["s"], x["far"]) & _ratio_ok(acc["a"], x["amount"], cfg), taken).otherwise(acc)

    rows = rows.withColumn("f", F.aggregate("c", start, step)).where(F.size(F.col("f.g")) >= least)
    return rows.select(*keys, "centre", F.col("f.g").alias("group"), F.col("f.s").alias("others"))


def find_fanin(df: DataFrame, cfg: MotifConfig = MotifConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Many sources into one node; nodes are the sources and then the node."""
    rows = _fan(df, "dst_node", "src_node", cfg.r_min_fanin, cfg, keys)
    if cfg.dedup_fanin:
        first = Window.partitionBy(*keys, "centre", F.array_sort("others")).orderBy(F.col("group")[0]["step"], F.col("group")[0]["event_id"])
        rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    return instances(rows, "fanin", F.concat("others", F.array("centre")), F.col("group"), keys)


def find_fanout(df: DataFrame, cfg: MotifConfig = MotifConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """One node to many targets; nodes are the node and then the targets."""
    rows = _fan(df, "src_node", "dst_node", cfg.r_min_fanout, cfg, keys)
    return instances(rows, "fanout", F.concat(F.array("centre"), F.col("others")), F.col("group"), keys)


def _same(a: str, b: str, keys: tuple[str, ...]) -> list[Column]:
    return [F.col(f"{a}_{k}") == F.col(f"{b}_{k}") for k in keys]


def _next(a: str, b: str, cfg: MotifConfig, keys: tuple[str, ...]) -> list[Column]:
    """b, a table of _reached(), leaves where a arrives, 1 to delta steps later, with a fitting amount."""
    lag = F.col(f"{b}_step") - F.col(f"{a}_step")
    met = _stretch(F.col(f"{a}_step"), cfg.delta) == F.col(f"{b}_stretch")
    return [*_same(a, b, keys), F.col(f"{a}_dst") == F.col(f"{b}_src"), met, lag > 0, lag <= cfg.delta, _ratio_ok(F.col(f"{a}_amount"), F.col(f"{b}_amount"), cfg)]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def _loads(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    ends = df.select(*keys, F.explode(F.array("src_node", "dst_node")).alias("__node"))
    return ends.groupBy(*keys, "__node").agg(F.count("*").alias("__load"))


def _weighed(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """df with src_load and dst_load: the events that its source and its target have."""
    load = settled(_loads(df, keys))
    for end in ("src", "dst"):
        df = df.join(load.select(*keys, F.col("__node").alias(f"{end}_node"), F.col("__load").alias(f"{end}_load")), [*keys, f"{end}_node"])
    return df


def cycle_pairs(df: DataFrame, cfg: MotifConfig = MotifConfig(), keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of edges of a cycle a: u to v, b: v to w, c: w to u, that meet in the node of the cycle with the fewest
    events (v before w before u among equals): (a, b) at v, (b, c) at w, (a, c) at u.

    A node with very many events only joins edges whose other ends have as many, so pairs don't grow with the square of a
    hub's events.
    """
    rows = settled(_weighed(df, keys), *keys, "src_node", "step")

    def edge(p: str) -> DataFrame:
        loads = {f"{p}_src_load": F.col("src_load"), f"{p}_dst_load": F.col("dst_load")}
        named = {f"{p}_{c}": F.col(s) for c, s in (("src", "src_node"), ("dst", "dst_node"), ("step", "step"), ("event_id", "event_id"))}
        alert = F.col("is_sar") if "is_sar" in rows.columns else F.lit(0)
        cols = named | loads | {f"{p}_amount": F.col("amount").cast("double"), f"{p}_alert": alert.cast("int")} | {f"{p}_{k}": F.col(k) for k in keys}
        return rows.where("src_node <> dst_node").select(*(c.alias(n) for n, c in cols.items()))

    a, b, c = edge("a"), edge("b"), edge("c")
    late_b, late_c = _reached(b, "b", cfg.delta), _reached(c, "c", cfg.delta)
    col = F.col
    at_v = a.where("a_dst_load <= a_src_load").join(late_b.where("b_src_load <= b_dst_load"), _all([*_next("a", "b", cfg, keys), col("b_dst") != col("a_src")]))
    at_w = late_b.where("b_dst_load < b_src_load").join(late_c.where("c_src_load <= c_dst_load"), _all([*_next("b", "c", cfg, keys), col("c_dst") != col("b_src")]))
    lag, met = col("c_step") - col("a_step"), _stretch(col("a_step"), 2 * cfg.delta) == col("c_stretch")
    back = [*_same("a", "c", keys), col("c_dst") == col("a_src"), met, lag > 1, lag <= 2 * cfg.delta, col("c_src") != col("a_dst")]
    at_u = a.where("a_src_load < a_dst_load").join(_reached(c, "c", 2 * cfg.delta).where("c_dst_load < c_src_load"), _all(back))
    return at_v, at_w, at_u


def _has_hub(df: DataFrame, keys: tuple[str, ...]) -> bool:
    return not _loads(df, keys).where(F.col("__load") > HUB).isEmpty()


def find_cycle3(df: DataFrame, cfg: MotifConfig = MotifConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """u to v to w to u, three nodes.  Without a hub, edges meet in time order; with one (by a count of events a node) in
    the least node of each cycle, and the third edge, whose both ends are then known, closes it.  Rows are the same."""
    if not _has_hub(df, keys):
        return _chains(df, ("cycle3",), cfg, keys)
    a, b, c = (_named(df, p, keys) for p in "abc")
    at_v, at_w, at_u = cycle_pairs(df, cfg, keys)
    first = at_v.join(_reached(c, "c", cfg.delta), _all([*_next("b", "c", cfg, keys), F.col("c_dst") == F.col("a_src")]))
    second = at_w.join(a, _all([*_next("a", "b", cfg, keys), F.col("a_src") == F.col("c_dst")]))
    third = at_u.drop("c_stretch").join(_reached(b, "b", cfg.delta), _all([*_next("a", "b", cfg, keys), F.col("b_dst") == F.col("c_src"), F.col("c_step") > F.col("b_step"), F.col("c_step") - F.col("b_step") <= cfg.delta, _ratio_ok(F.col("b_amount"), F.col("c_amount"), cfg)]))
    names = [f"{p}_{x}" for p in "abc" for x in (*keys, "src", "dst", "step", "event_id", "amount", "alert")]
    rows = first.select(*names).unionByName(second.select(*names)).unionByName(third.select(*names))
    rows = rows.withColumns({k: F.col(f"a_{k}") for k in keys})
    return instances(rows, "cycle3", F.array("a_src", "a_dst", "b_dst", "a_src"), F.array(_event("a"), _event("b"), _event("c")), keys)


def _pairs(df: DataFrame, cfg: MotifConfig, keys: tuple[str, ...]) -> DataFrame:
    """Chains u to v to w of three nodes."""
    a, b = _named(df, "a", keys), _reached(_named(df, "b", keys), "b", cfg.delta)
    rows = a.join(b, _all([*_next("a", "b", cfg, keys), F.col("b_dst") != F.col("a_src"), F.col("b_dst") != F.col("a_dst"), F.col("a_src") != F.col("a_dst")]))
    return rows.drop("b_stretch", "b_src", *(f"b_{k}" for k in keys)).withColumns({"b_src": F.col("a_dst"), **{f"b_{k}": F.col(f"a_{k}") for k in keys}})


def _chains(df: DataFrame, names: tuple[str, ...], cfg: MotifConfig, keys: tuple[str, ...]) -> DataFrame:
    """Chains u to v to w to x: three-node cycles and four-node relays, those of `names`, from one join."""
    other = [F.col("c_dst") != F.col(x) for x in ("a_src", "a_dst", "b_dst")]
    types = {t: holds for t, holds in (("cycle3", F.col("c_dst") == F.col("a_src")), ("relay4", _all(other))) if t in names}
    c = _reached(_named(df, "c", keys), "c", cfg.delta)
    kind = F.coalesce(*(F.when(holds, F.lit(t)) for t, holds in types.items()))
    rows = _pairs(df, cfg, keys).join(c, _all([*_next("b", "c", cfg, keys), reduce(lambda x, y: x | y, types.values())]))
    rows = rows.withColumns({k: F.col(f"a_{k}") for k in keys})
    return instances(rows, kind, F.array("a_src", "a_dst", "b_dst", "c_dst"), F.array(_event("a"), _event("b"), _event("c")), keys)


def find_relay4(df: DataFrame, cfg: MotifConfig = MotifConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """u to v to w to x, four nodes."""
    return _chains(df, ("relay4",), cfg, keys)


def find_split_merge(df: DataFrame, cfg: MotifConfig = MotifConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """u to v1 and v2, which both reach z: every pair of second legs, each 1 to 2 delta steps after the first leg.

    first_edge_only takes only the earliest leg from v1 to z; strict_chronology also wants the leg from v2 to be later
    than the one into v2.

    Each event meets the legs that leave its target, and goes once, with the list of them, to its source; there it is laid
    out by z, and paths from u to z through one node alone go.  So neither pairs of first legs nor paths are shuffled as
    rows.  Tasks grow with the events, so lists of legs of a task fit its memory.
    """
    df = settled(df, *keys, "src_node", "step")
    e, leg, tasks = _named(df, "e", keys), _named(df, "l", keys), parts(df)
    # a leg is up to 2 delta steps after the first event of the pair, which is up to delta steps before its own
    base, reach = F.col("e_step") - cfg.delta, 3 * cfg.delta
    e = e.withColumn("e_stretch", _stretch(base, reach)).repartition(tasks, *(f"e_{k}" for k in keys), "e_dst", "e_stretch")
    leg = leg.withColumn("l_stretch", F.explode(_stretches(F.col("l_step"), reach))).repartition(tasks, *(f"l_{k}" for k in keys), "l_src", "l_stretch")
    lag = F.col("l_step") - F.col("e_step")
    fits = [F.col("l_src") == F.col("e_dst"), F.col("e_stretch") == F.col("l_stretch"), lag > -cfg.delta, lag <= 2 * cfg.delta, F.col("l_dst") != F.col("e_src"), F.col("l_dst") != F.col("e_dst")]
    if cfg.strict_chronology:
        fits.append(lag > 0)
    paths = e.join(leg, _all([*_same("e", "l", keys), *fits, _ratio_ok(F.col("e_amount"), F.col("l_amount"), cfg)]))
    first = ("src", "dst", "step", "event_id", "amount", "alert")
    own = [*(f"e_{k}" for k in keys), *(f"e_{c}" for c in first)]
    # the join's keys come first, so that lists are made where its rows are
    there = [*(f"l_{k}" for k in keys), "l_src", "l_stretch"]
    lists = paths.groupBy(*there, *own).agg(F.collect_list(F.struct(F.col("l_dst").alias("z"), *(F.col(f"l_{c}").alias(c) for c in first[2:]))).alias("legs"))
    lists = lists.select(*own, "legs", F.explode(_stretches(F.col("e_step"), cfg.delta)).alias("stretch"))
    at = [*(f"e_{k}" for k in keys), "e_src", "stretch"]
    rows = lists.repartition(tasks, *at).select(*own, "stretch", F.explode("legs").alias("leg")).withColumn("z", F.col("leg.z"))
    group = Window.partitionBy(*at, "z")
    rows = rows.withColumns({"__lo": F.min("e_dst").over(group), "__hi": F.max("e_dst").over(group)}).where("__lo < __hi").drop("__lo", "__hi")
    seed = (F.col("stretch") == _stretch(F.col("e_step"), cfg.delta)) & (F.col("leg.step") > F.col("e_step"))
    if cfg.first_edge_only:
        early = Window.partitionBy(*at, "z", "e_event_id").orderBy(F.col("leg.step") <= F.col("e_step"), F.col("leg.step"), F.col("leg.event_id"))
        rows = rows.withColumn("__r", F.row_number().over(early))
        seed = seed & (F.col("__r") == 1)
    event = lambda c: F.struct(*(F.col(f"e_{x}").alias(x) for x in c))
    fellow = F.struct(event(first[1:]).alias("q"), F.col("leg").alias("s"))
    near = group.orderBy("e_step").rangeBetween(0, cfg.delta)
    rows = rows.select(*(F.col(f"e_{k}").alias(k) for k in keys), F.col("e_src").alias("u"), "z", event(first[1:]).alias("p"), F.col("leg").alias("r"), seed.alias("seed"), F.collect_list(fellow).over(near).alias("c")).where("seed")
    p = F.col("p")

    def meets(x: Column) -> Column:
        q, s = x["q"], x["s"]
        later = (q["step"] > p["step"]) | ((q["step"] == p["step"]) & (q["event_id"] > p["event_id"]))
        return later & (q["dst"] != p["dst"]) & (q["dst"] != F.col("u")) & (s["step"] > p["step"]) & (s["step"] - p["step"] <= 2 * cfg.delta) & _ratio_ok(p["amount"], q["amount"], cfg)

    rows = rows.withColumn("x", F.explode(F.filter("c", meets)))
    four = (p, F.col("x.q"), F.col("r"), F.col("x.s"))
    placed = F.array(*(F.struct(y["step"].alias("step"), F.lit(i).alias("place"), *(y[c].alias(c) for c in ("event_id", "amount", "alert"))) for i, y in enumerate(four)))
    return instances(rows, "split_merge", F.array("u", p["dst"], F.col("x.q.dst"), "z"), F.sort_array(placed), keys)


MATCHERS = {"fanin": find_fanin, "fanout": find_fanout, "cycle3": find_cycle3, "relay4": find_relay4, "split_merge": find_split_merge}


def run_all(df: DataFrame, cfg: MotifConfig = MotifConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """All enabled types, from one written table of events.  max_instances, off by default, keeps the first of each type
    by first step and edges."""
    df = settled(df, *keys, "src_node", "step") if len(cfg.enabled) > 1 else df
    alone = list(cfg.enabled)
    found = []
    if {"cycle3", "relay4"} <= set(alone) and not _has_hub(df, keys):  # both close or go on with the same chains
        alone = [t for t in alone if t not in ("cycle3", "relay4")]
        found = [_chains(df, ("cycle3", "relay4"), cfg, keys)]
    out = reduce(DataFrame.unionByName, found + [MATCHERS[t](df, cfg, keys) for t in alone])
    if cfg.max_instances:
        first = Window.partitionBy(*keys, "motif_type").orderBy(F.array_min("steps"), F.array_join("edges", ","))
        out = out.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= cfg.max_instances).drop("__r")
    return out


def hub_prune(df: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Events whose source has no more events than the truncated quantile of events a source.  It changes results."""
    counts = df.groupBy("src_node").agg(F.count("*").alias("n"))
    bound = counts.select(F.percentile("n", F.lit(quantile)).cast("int").alias("b")).scalar()
    return df.join(counts.where(F.col("n") > bound).select("src_node"), "src_node", "left_anti").select(*df.columns)


def chunked(df: DataFrame, cfg: MotifConfig = MotifConfig(), size: int = 7) -> DataFrame:
    """Instances found chunk by chunk with delta steps looked back: those that start in a chunk and end in it.  Fewer
    than run_all() finds; for comparison with chunked runs."""
    from .windows import chunk_windows

    rows = chunk_windows(df, size, cfg.delta)
    found = run_all(rows, cfg, ("chunk_start",))
    return found.where(F.array_min("steps") >= F.col("chunk_start"))
