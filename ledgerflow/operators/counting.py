"""How many instances of each motif type there are, without making them: what a null model needs of a permutation.

Events are dealt twice, to the node and stretch of time where they arrive and where they leave; there a task counts fans and
pairs each arriving event with the events that leave soon.  Pairs go on once, as lists: the nodes before an event to its
target, where chains end, and the legs after an event to its source, where split and merge close.  Arrays of a task hold
some groups of (node, stretch) at a time, and pairs are made a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MotifConfig
from ..functions.tables import parts, settled
from .motifs import _has_hub, _stretch, _stretches

#: Rows that a task holds at a time, about, and pairs that it makes at a time.
ROWS, PAIRS = 1 << 18, 1 << 21
_FIELDS = "role int, own boolean, far long, step int, event_id long, amount double, legs binary, lags binary"
_NAMES = ["role", "own", "far", "step", "event_id", "amount", "legs", "lags"]
_TYPES = [pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
#: Roles of a row at a node: it leaves, it arrives, it arrives with the nodes before it, it leaves with the legs after it;
#: a count has minus the number of its type.
LEAVES, ARRIVES, AFTER, PATHS = range(4)
_KINDS = {"fanin": -1, "fanout": -2, "cycle3": -3, "relay4": -4, "split_merge": -5}


def countable(df: DataFrame, cfg: MotifConfig) -> bool:
    """Whether count_motifs() gives what the matchers find in df: no option that looks at whole instances, no null and no
    hub (whose lists would be long)."""
    if cfg.dedup_fanin or cfg.first_edge_only:
        return False
    needed = ("src_node", "dst_node", "step", "event_id", "amount")
    return df.where(" or ".join(f"{c} is null" for c in needed)).isEmpty() and not _has_hub(df, ())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Columns of some whole groups of rows sorted by the first three columns; those of binaries as Arrow arrays."""
    held, size, enough = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            new = _new(*(table.column(i).to_numpy() for i in range(3)))
            cut = int(np.flatnonzero(new)[-1])
            if cut:
                yield _columns(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
            enough = max(ROWS, 2 * size)
    if size:
        yield _columns(pa.Table.from_batches(held).combine_chunks())


def _columns(table: pa.Table) -> list:
    return [c.combine_chunks() if pa.types.is_binary(c.type) else c.to_numpy() for c in table.columns]


def _new(*keys: np.ndarray) -> np.ndarray:
    """True where a row has another key than the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _fits(before: np.ndarray, after: np.ndarray, cfg: MotifConfig) -> np.ndarray:
    with np.errstate(all="ignore"):
        ratio = after / before
        return (before > 0) & (ratio >= cfg.rho_min) & (ratio <= cfg.rho_max)


def _time(group: np.ndarray, step: np.ndarray) -> np.ndarray:
    """One number that goes by group and then by step."""
    return (group.astype(np.int64) << np.int64(32)) + (step.astype(np.int64) + np.int64(1 << 31))


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every j from low[i] to high[i], PAIRS at a time (or those of one i)."""
    many = np.maximum(high - low, 0)
    until = np.cumsum(many)
    begin = 0
    while begin < len(many):
        end = max(begin + 1, int(np.searchsorted(until, (until[begin - 1] if begin else 0) + PAIRS, "right")))
        own = many[begin:end]
        if own.any():
            i = np.repeat(np.arange(begin, end), own)
            yield i, low[i] + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        begin = end


def fan_seeds(group, own, far, step, event_id, amount, least: int, cfg: MotifConfig) -> np.ndarray:
    """Places of the seeds whose greedy fan has `least` far ends; rows are sorted by group, step and event_id."""
    end = np.searchsorted(_time(group, step), _time(group, step + cfg.delta), "right")
    at = np.flatnonzero(own & (end - np.arange(len(group)) >= least))
    if least <= 1:
        return at
    last, taken, many = amount[at], [far[at]] + [np.zeros(len(at), np.int64) for _ in range(least - 1)], np.ones(len(at), np.int64)
    found, ahead = [], 1
    while len(at):
        j = at + ahead
        ok = ((step[j] > step[at]) | (event_id[j] > event_id[at])) & _fits(last, amount[j], cfg)
        for k, t in enumerate(taken):
            ok &= (many <= k) | (far[j] != t)
        for k in range(1, least):
            now = ok & (many == k)
            taken[k][now] = far[j[now]]
        last, many, ahead = np.where(ok, amount[j], last), many + ok, ahead + 1
        found.append(at[many == least])
        left = (many < least) & (at + ahead < end[at])
        at, last, many, taken = at[left], last[left], many[left], [t[left] for t in taken]
    return np.concatenate(found) if found else at


def _lists(values: np.ndarray, of: np.ndarray) -> pa.Array:
    """A binary for each run of equal numbers in `of`, of the values there."""
    first = np.append(np.flatnonzero(_new(of)), len(of)) if len(of) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(lists: pa.Array, rows: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of the binaries of some rows, number of them in each)."""
    if not len(rows):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    lists = lists.take(pa.array(rows))
    edges = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    data = np.frombuffer(lists.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    return data.view(kind), np.diff(edges).astype(np.int64) // np.dtype(kind).itemsize


def _batch(key, node, cols: list, names: list[str]) -> pa.RecordBatch:
    """Rows of the key, the node and _FIELDS; what is None is 0, or null for binaries."""

    def column(c, kind: pa.DataType) -> pa.Array:
        if c is None:
            return pa.nulls(len(key), kind) if pa.types.is_binary(kind) else pa.array(np.zeros(len(key), kind.to_pandas_dtype()), kind)
        return c if isinstance(c, pa.Array) else pa.array(c, kind)

    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), *(column(c, t) for c, t in zip(cols, _TYPES, strict=True))], names)


def _counts(key: np.ndarray, type_: str, names: list[str], weight: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row a key and type: its number as the event's."""
    if len(key):
        kinds, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, weights=weight).astype(np.int64)  # whole numbers far under 2**53
        yield _batch(kinds, np.zeros(len(kinds), np.int64), [np.full(len(kinds), _KINDS[type_], np.int32), None, None, None, n, None, None, None], names)


def _meet(cols: list, cfg: MotifConfig, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Fans, and lists of what lies before and after an event, of rows (key, node, stretch, role, own, far, step, event_id,
    amount) in groups of node and stretch."""
    key, node, stretch, role, own, far, step, event_id, amount = cols
    group = np.cumsum(_new(key, node, stretch))
    step = step.astype(np.int64)
    out, into = np.flatnonzero(role == LEAVES), np.flatnonzero(role == ARRIVES)
    for type_, at, least in (("fanout", out, cfg.r_min_fanout), ("fanin", into, cfg.r_min_fanin)):
        if type_ in cfg.enabled:
            yield from _counts(key[at[fan_seeds(*(x[at] for x in (group, own, far, step, event_id, amount)), least, cfg)]], type_, names)
    at, there = into[own[into]], _time(group[out], step[out])
    low = np.searchsorted(there, _time(group[at], step[at] - cfg.delta), "right")
    high = np.searchsorted(there, _time(group[at], step[at] + 2 * cfg.delta), "right")
    for i, j in _ranges(low, high):
        a, b = at[i], out[j]
        ok = _fits(amount[a], amount[b], cfg) & (far[b] != far[a]) & (far[b] != node[a])
        a, b = a[ok], b[ok]
        lag = step[b] - step[a]
        if {"cycle3", "relay4"} & set(cfg.enabled):
            near = (lag > 0) & (lag <= cfg.delta) & (far[a] != node[a])
            x, y = a[near], b[near]
            order = np.argsort(y, kind="stable")
            x, y = x[order], y[order]
            e = y[_new(y)] if len(y) else y
            yield _batch(key[e], far[e], [np.full(len(e), AFTER, np.int32), None, node[e], step[e].astype(np.int32), event_id[e], amount[e], _lists(far[x], y), None], names)
        if "split_merge" in cfg.enabled:
            if cfg.strict_chronology:
                a, b = a[lag > 0], b[lag > 0]
            e = a[_new(a)] if len(a) else a
            yield _batch(key[e], far[e], [np.full(len(e), PATHS, np.int32), None, node[e], step[e].astype(np.int32), event_id[e], amount[e], _lists(far[b], a), _lists(step[b].astype(np.int32), a)], names)


def _close(cols: list, cfg: MotifConfig, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Chains and split-merges of rows as those of _meet(), with the lists that it has made."""
    key, node, stretch, role, own, far, step, event_id, amount, legs, lags = cols
    group = np.cumsum(_new(key, node, stretch))
    for type_, number in _KINDS.items():  # counts pass through
        mine = role == number
        yield from _counts(key[mine], type_, names, event_id[mine])
    step = step.astype(np.int64)
    out, after, paths = (np.flatnonzero(role == r) for r in (LEAVES, AFTER, PATHS))
    before, many = _values(legs, after, np.int64)
    first, there = np.cumsum(many) - many, _time(group[out], step[out])
    low = np.searchsorted(there, _time(group[after], step[after]), "right")
    high = np.searchsorted(there, _time(group[after], step[after] + cfg.delta), "right")
    for i, j in _ranges(low, high):
        b, c = after[i], out[j]
        ok = _fits(amount[b], amount[c], cfg) & (far[c] != far[b]) & (far[c] != node[b])
        i, c = i[ok], c[ok]
        if not len(i):
            continue
        for x, y in _ranges(first[i], first[i] + many[i]):
            closed = before[y] == far[c[x]]
            yield from _counts(key[c[x[closed]]], "cycle3", names)
            yield from _counts(key[c[x[~closed]]], "relay4", names)
    lists = _values(legs, paths, np.int64), _values(lags, paths, np.int32)
    yield from _counts(_merges(*(x[paths] for x in (key, node, group, own, far, step, event_id, amount)), *lists, cfg), "split_merge", names)


def _merges(key, node, group, own, far, step, event_id, amount, ends, times, cfg: MotifConfig) -> np.ndarray:
    """The key of each split-merge among paths: an event and the legs after it (targets and steps)."""
    z, many = ends
    row, leg = np.repeat(np.arange(len(many)), many), times[0].astype(np.int64)
    # most targets have one path from a node: a table of counts tells them
    cell = (group[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + z.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 22)
    keep = np.bincount(cell.astype(np.int64), minlength=1)[cell.astype(np.int64)] > 1 if len(cell) else np.zeros(0, bool)
    row, z, leg = row[keep], z[keep], leg[keep]
    order = np.lexsort((event_id[row], step[row], z, group[row]))
    row, z, leg = row[order], z[order], leg[order]
    if not len(row):
        return key[:0]
    same = np.cumsum(_new(group[row], z))
    end = np.searchsorted(_time(same, step[row]), _time(same, step[row] + cfg.delta), "right")
    begin = np.arange(len(row)) + 1
    end = np.where(own[row] & (leg > step[row]), end, begin)
    found = []
    for i, j in _ranges(begin, end):
        p, q, lag = row[i], row[j], leg[j] - step[row[i]]
        ok = ((step[q] > step[p]) | (event_id[q] > event_id[p])) & (far[q] != far[p]) & (far[q] != node[q]) & (lag > 0) & (lag <= 2 * cfg.delta) & _fits(amount[p], amount[q], cfg)
        found.append(key[p[ok]])
    return np.concatenate(found) if found else key[:0]


def count_motifs(df: DataFrame, cfg: MotifConfig, key: str) -> DataFrame:
    """key, motif_type, support of the enabled types in each part of df (a table of events for which countable() holds)."""
    df = settled(df, key, "src_node", "step")
    tasks, names, delta = parts(df), [key, "node", *_NAMES], cfg.delta
    schema = f"{key} {dict(df.dtypes)[key]}, node long, {_FIELDS}"
    event = ["step", "event_id", F.col("amount").cast("double").alias("amount")]
    leaves = df.select(key, F.col("src_node").alias("node"), F.lit(LEAVES).alias("role"), F.col("dst_node").alias("far"), *event)
    arrives = df.select(key, F.col("dst_node").alias("node"), F.lit(ARRIVES).alias("role"), F.col("src_node").alias("far"), *event)

    def placed(rows: DataFrame, at: Column, reach: int, seen: int) -> DataFrame:
        """Rows in the stretches that see them; own: in that one where they see others."""
        return rows.withColumn("stretch", F.explode(_spread(at, reach, seen))).withColumn("own", F.col("stretch") == _stretch(at, reach))

    def grouped(rows: DataFrame, *cols: str) -> DataFrame:
        rows = rows.select(key, "node", "stretch", "role", "own", "far", "step", "event_id", "amount", *cols).repartition(tasks, key, "node", "stretch")
        return rows.sortWithinPartitions("node", key, "stretch", "role", "step", "event_id", "far", "amount")  # nodes tell rows apart soonest

    reach = 3 * delta  # from delta steps before an event to 2 delta steps after it
    first = placed(leaves, F.col("step"), reach, reach).unionByName(placed(arrives, F.col("step") - delta, reach, delta))
    met = grouped(first).mapInArrow(lambda batches: (r for cols in _groups(batches) for r in _meet(cols, cfg, names)), schema)
    # at the next node rows see others up to delta steps later; a list of what lies before an event is there once
    ahead = placed(leaves, F.col("step"), delta, delta).select("*", *(F.lit(None).cast("binary").alias(c) for c in ("legs", "lags")))
    own = _stretch(F.col("step"), delta)
    near = met.drop("own").withColumn("stretch", F.explode(F.when(F.col("role") == PATHS, _stretches(F.col("step"), delta)).otherwise(F.array(own)))).withColumn("own", F.col("stretch") == own)
    closed = grouped(near.unionByName(ahead), "legs", "lags").mapInArrow(lambda batches: (r for cols in _groups(batches) for r in _close(cols, cfg, names)), schema)
    types = F.create_map(*(F.lit(x) for t, n in _KINDS.items() for x in (n, t)))
    out = closed.groupBy(key, types[F.col("role")].alias("motif_type")).agg(F.sum("event_id").alias("support")).where(F.col("motif_type").isin(*cfg.enabled) & (F.col("support") > 0))
    return out if cfg.max_instances is None else out.withColumn("support", F.least("support", F.lit(cfg.max_instances).cast("bigint")))


def _spread(at: Column, reach: int, seen: int) -> Column:
    """Stretches, in reaches of `reach`, from which a row at `at` is at most `seen` steps away."""
    own = _stretch(at, reach)
    return F.when(_stretch(at - seen, reach) < own, F.array(own - 1, own)).otherwise(F.array(own))
