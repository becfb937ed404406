"""The catalogue of queries, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import MOTIFS, CommunityConfig, MotifConfig
from .functions.tables import settled, side_by_side
from .operators import communities as com
from .operators import detection, edges, encoding, features, motifs, significance, tracking, windows
from .plans import pipelines, views
from .sources import transactions as tx

CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

# ---- plain columns, so that both engines' rows compare -------------------------------------------------------------


def plain(df: DataFrame, places: int = 6) -> DataFrame:
    """Integers as bigint, floating numbers rounded, arrays of integers as text."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int", "bigint"):
            c = c.cast("bigint")
        elif kind in ("float", "double"):
            c = F.round(c.cast("double"), places)
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(name))
    return df.select(*cols)


def plain_motifs(found: DataFrame) -> DataFrame:
    """Instances with amounts in hundredths and ratios in ten-thousandths, as text."""
    whole = lambda c, n: F.transform(c, lambda x: F.round(x * n).cast("bigint"))
    return plain(found.withColumn("amounts", whole("amounts", 100)).withColumn("ratios", whole("ratios", 10000)))


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        CATALOGUE[name or f.__name__] = (f, sql)
        return f

    return add


# ---- common SQL ----------------------------------------------------------------------------------------------------

EV = """ev AS (SELECT * FROM (SELECT event_id, user_id AS src_node, lead(user_id) OVER (ORDER BY ts, event_id) AS dst_node, value AS amount,
  CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 86400000000 AS BIGINT) AS step, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_sar FROM events)
  WHERE src_node <> dst_node AND amount > 0)"""
CP = """raw AS (SELECT o_custkey AS src_node, l_partkey AS dst_node, CAST(l_extendedprice AS FLOAT) AS amount,
  CAST((epoch_us(CAST(l_shipdate AS TIMESTAMP)) - min(epoch_us(CAST(l_shipdate AS TIMESTAMP))) OVER ()) // 86400000000 AS BIGINT) AS step,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_sar FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cp AS (SELECT * FROM raw WHERE src_node <> dst_node AND amount > 0)"""


def _windows_sql(size: int, stride: int, source: str = "ev") -> str:
    return f"""o AS (SELECT min(step) AS o, max(step) AS m FROM {source}), k AS (SELECT o + k * {stride} AS a, k FROM o, (SELECT unnest(range(0, 10000)) AS k) WHERE o + k * {stride} <= m),
wi AS (SELECT {source}.*, k.k AS window_index, a AS step_start, a + {size - 1} AS step_end FROM {source} JOIN k ON step BETWEEN a AND a + {size - 1}),
wn AS (SELECT wi.*, dense_rank() OVER (ORDER BY window_index) - 1 AS window_id FROM wi)"""


def _text(list_: str) -> str:
    return f"array_to_string({list_}, ',')"


def _motif_sql(source: str, motif: str, nodes: str, keys: str = "", quotient: bool = False) -> str:
    """MOTIF columns of rows with lists ed (edges), st (steps), am (amounts), al (alerts) and the expression `nodes`.

    quotient: a ratio is the quotient as it prints, rounded half up to 4 places, which is the query's rule; else DuckDB
    rounds the product of quotient and 10,000, which for quotients next to a half is chance (38.41 / 40, 5.81 / 8).
    """
    ratio = "round(CAST(CAST(am[i] / am[i - 1] AS VARCHAR) AS DECIMAL(38, 20)), 4)" if quotient else "round(am[i] / am[i - 1], 4)"
    return f"""SELECT {keys} '{motif}' AS motif_type, {_text(nodes)} AS nodes, {_text('ed')} AS edges, {_text('st')} AS steps,
  {_text("list_transform(am, lambda x: CAST(round(x * 100) AS BIGINT))")} AS amounts, {_text("list_transform(range(2, len(st) + 1), lambda i: st[i] - st[i - 1])")} AS lags,
  {_text(f"list_transform(range(2, len(st) + 1), lambda i: CAST(round({ratio} * 10000) AS BIGINT))")} AS ratios, CAST(list_sum(al) AS BIGINT) AS n_alert FROM {source}"""


def _fan_sql(centre: str, far: str, least: int = 3, events: str = "ev", keys: tuple[str, ...] = ()) -> str:
    """CTEs up to `fan`: x, seed, ed, st, am, al, sr (far ends) of greedy groups."""
    same = "".join(f" AND s.{k} = e.{k}" for k in keys)
    kk = "".join(f", s.{k}" for k in keys)
    ek = "".join(f", {k}" for k in keys)
    gk = "".join(f", g.{k}" for k in keys)
    jk = "".join(f" AND c.{k} = g.{k}" for k in keys)
    pk = "".join(f", s.{k}" for k in keys)
    return f"""c AS (SELECT s.event_id AS seed{kk}, e.event_id, e.step, e.amount, e.is_sar, e.{far} AS far, row_number() OVER (PARTITION BY s.event_id{pk} ORDER BY e.step, e.event_id) AS k
  FROM {events} s JOIN {events} e ON e.{centre} = s.{centre} AND e.step - s.step BETWEEN 0 AND 3 AND (e.step > s.step OR e.event_id > s.event_id){same}),
g AS (SELECT event_id AS seed{ek}, {centre} AS x, CAST(0 AS BIGINT) AS k, amount AS last, [{far}] AS sr, [event_id] AS ed, [step] AS st, [amount] AS am, [is_sar] AS al FROM {events}
  UNION ALL
  SELECT g.seed{gk}, g.x, c.k, CASE WHEN ok THEN c.amount ELSE g.last END, CASE WHEN ok THEN list_append(sr, c.far) ELSE sr END, CASE WHEN ok THEN list_append(ed, c.event_id) ELSE ed END,
    CASE WHEN ok THEN list_append(st, c.step) ELSE st END, CASE WHEN ok THEN list_append(am, c.amount) ELSE am END, CASE WHEN ok THEN list_append(al, c.is_sar) ELSE al END
  FROM g JOIN c ON c.seed = g.seed AND c.k = g.k + 1{jk}, LATERAL (SELECT NOT list_contains(sr, c.far) AND c.amount / g.last BETWEEN 0.5 AND 2.0 AS ok)),
fan AS (SELECT * FROM g WHERE len(ed) >= {least} QUALIFY row_number() OVER (PARTITION BY seed{ek} ORDER BY k DESC) = 1)"""


def _pair(a: str, b: str) -> str:
    return f"{b}.src_node = {a}.dst_node AND {b}.step - {a}.step BETWEEN 1 AND 3 AND {b}.amount / {a}.amount BETWEEN 0.5 AND 2.0"


def _lists(*names: str) -> str:
    return ", ".join(f"[{', '.join(f'{n}.{c}' for n in names)}] AS {a}" for c, a in (("event_id", "ed"), ("step", "st"), ("amount", "am"), ("is_sar", "al")))


def _chain_sql(closed: bool, events: str = "ev", keys: tuple[str, ...] = ()) -> str:
    last = "c.dst_node = a.src_node" if closed else "c.dst_node NOT IN (a.src_node, a.dst_node, b.dst_node)"
    same = "".join(f" AND b.{k} = a.{k} AND c.{k} = a.{k}" for k in keys)
    kk = "".join(f"a.{k}, " for k in keys)
    return f"""SELECT {kk}a.src_node AS u, a.dst_node AS v, b.dst_node AS w, c.dst_node AS x, {_lists('a', 'b', 'c')} FROM {events} a JOIN {events} b ON {_pair('a', 'b')}
  JOIN {events} c ON {_pair('b', 'c')} WHERE b.dst_node NOT IN (a.src_node, a.dst_node) AND {last}{same}"""


def _split_sql(events: str = "ev", keys: tuple[str, ...] = (), strict: bool = False, first: bool = False) -> str:
    leg = lambda f, e: f"{e}.src_node = {f}.dst_node AND {e}.step - p.step BETWEEN 1 AND 6 AND {e}.amount / {f}.amount BETWEEN 0.5 AND 2.0 AND {e}.dst_node NOT IN (p.src_node, p.dst_node, q.dst_node)"
    same = "".join(f" AND q.{k} = p.{k} AND r.{k} = p.{k} AND s.{k} = p.{k}" for k in keys)
    kk = "".join(f"p.{k}, " for k in keys)
    only = "QUALIFY dense_rank() OVER (PARTITION BY p.event_id, q.event_id, r.dst_node ORDER BY r.step, r.event_id) = 1" if first else ""
    if first:
        # the earliest leg from v1 to z must be picked before the other leg is looked for
        return f"""half AS (SELECT p.event_id AS pe, q.event_id AS qe, r.event_id AS re FROM {events} p JOIN {events} q ON q.src_node = p.src_node AND (q.step > p.step OR (q.step = p.step AND q.event_id > p.event_id)) AND q.step - p.step <= 3
  AND q.dst_node NOT IN (p.src_node, p.dst_node) AND q.amount / p.amount BETWEEN 0.5 AND 2.0 JOIN {events} r ON {leg('p', 'r')} QUALIFY row_number() OVER (PARTITION BY p.event_id, q.event_id, r.dst_node ORDER BY r.step, r.event_id) = 1),
four AS (SELECT p.src_node AS u, p.dst_node AS v, q.dst_node AS w, r.dst_node AS x, list_sort([struct_pack(step := p.step, place := 0, e := p.event_id, a := p.amount, l := p.is_sar), struct_pack(step := q.step, place := 1, e := q.event_id, a := q.amount, l := q.is_sar),
  struct_pack(step := r.step, place := 2, e := r.event_id, a := r.amount, l := r.is_sar), struct_pack(step := s.step, place := 3, e := s.event_id, a := s.amount, l := s.is_sar)]) AS z
  FROM half JOIN {events} p ON p.event_id = pe JOIN {events} q ON q.event_id = qe JOIN {events} r ON r.event_id = re JOIN {events} s ON {leg('q', 's')} AND s.dst_node = r.dst_node),
sm AS (SELECT u, v, w, x, list_transform(z, lambda t: t.e) AS ed, list_transform(z, lambda t: t.step) AS st, list_transform(z, lambda t: t.a) AS am, list_transform(z, lambda t: t.l) AS al FROM four)"""
    return f"""four AS (SELECT {kk}p.src_node AS u, p.dst_node AS v, q.dst_node AS w, r.dst_node AS x, list_sort([struct_pack(step := p.step, place := 0, e := p.event_id, a := p.amount, l := p.is_sar), struct_pack(step := q.step, place := 1, e := q.event_id, a := q.amount, l := q.is_sar),
  struct_pack(step := r.step, place := 2, e := r.event_id, a := r.amount, l := r.is_sar), struct_pack(step := s.step, place := 3, e := s.event_id, a := s.amount, l := s.is_sar)]) AS z
  FROM {events} p JOIN {events} q ON q.src_node = p.src_node AND (q.step > p.step OR (q.step = p.step AND q.event_id > p.event_id)) AND q.step - p.step <= 3 AND q.dst_node NOT IN (p.src_node, p.dst_node) AND q.amount / p.amount BETWEEN 0.5 AND 2.0
  JOIN {events} r ON {leg('p', 'r')} JOIN {events} s ON {leg('q', 's')} AND s.dst_node = r.dst_node{' AND s.step > q.step' if strict else ''}{same} {only}),
sm AS (SELECT {''.join(f'{k}, ' for k in keys)}u, v, w, x, list_transform(z, lambda t: t.e) AS ed, list_transform(z, lambda t: t.step) AS st, list_transform(z, lambda t: t.a) AS am, list_transform(z, lambda t: t.l) AS al FROM four)"""


def _all_motifs(events: str = "ev", keys: tuple[str, ...] = ()) -> str:
    """CTE `found`: all five types with lists ed, st, am, al and nodes nd."""
    fan_in, fan_out = _fan_sql("dst_node", "src_node", 3, events, keys), _fan_sql("src_node", "dst_node", 3, events, keys)
    for a in ("c", "g", "fan"):
        fan_out = _rename_cte(fan_out, a, f"{a}_out")
    kk = "".join(f"{k}, " for k in keys)
    return f"""{fan_in}, {fan_out}, {_split_sql(events, keys)},
found AS (SELECT {kk}'fanin' AS motif_type, list_append(sr, x) AS nd, ed, st, am, al FROM fan UNION ALL SELECT {kk}'fanout', list_prepend(x, sr), ed, st, am, al FROM fan_out
  UNION ALL SELECT {kk}'cycle3', [u, v, w, u], ed, st, am, al FROM ({_chain_sql(True, events, keys)}) UNION ALL SELECT {kk}'relay4', [u, v, w, x], ed, st, am, al FROM ({_chain_sql(False, events, keys)})
  UNION ALL SELECT {kk}'split_merge', [u, v, w, x], ed, st, am, al FROM sm)"""


def _rename_cte(sql: str, old: str, new: str) -> str:
    import re

    sql = re.sub(rf"\b{old} AS \(SELECT", f"{new} AS (SELECT", sql)
    sql = re.sub(rf"\bFROM {old}\b", f"FROM {new} {old}" if old != "fan" else f"FROM {new}", sql)
    return re.sub(rf"\bJOIN {old} ON", f"JOIN {new} {old} ON", sql)


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    """The events, written once: operators join them with themselves."""
    return settled(views.event_flows(spark, sf), "src_node", "step")


# ---- sources, windows, dictionary ----------------------------------------------------------------------------------


@query(f"WITH {CP} SELECT CAST(src_node AS BIGINT) AS src_node, CAST(dst_node AS BIGINT) AS dst_node, round(CAST(amount AS DOUBLE), 2) AS amount, step, CAST(is_sar AS BIGINT) AS is_sar FROM cp")
def load_normalize(spark, sf):
    return plain(views.order_flows(spark, sf), 2)


@query("SELECT CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 86400000000 AS BIGINT) AS step, count(*) AS n FROM events GROUP BY 1")
def step_from_timestamp(spark, sf):
    e = views.table(spark, sf, "events")
    return plain(tx.with_step(e, "ts").groupBy("step").agg(F.count("*").alias("n")))


@query(f"WITH {EV} SELECT src_node, dst_node, step, round(amount, 6) AS amount, CAST(is_sar AS BIGINT) AS is_sar, row_number() OVER (ORDER BY step, amount, dst_node, is_sar, src_node) - 1 AS event_id FROM ev")
def event_ids(spark, sf):
    rows = _ev(spark, sf).select(F.col("amount"), F.col("dst_node"), F.col("is_sar"), F.col("src_node"), F.col("step"))
    return plain(tx.with_event_id(tx.event_columns(rows)))


def _window_query(size: int, stride: int):
    def f(spark, sf):
        w = windows.assign_windows(_ev(spark, sf), size, stride)
        return plain(w.groupBy("window_index", "step_start", "step_end").agg(F.count("*").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"), F.sum("event_id").alias("ids")))

    sql = f"WITH {EV}, {_windows_sql(size, stride)} SELECT CAST(window_index AS BIGINT) AS window_index, step_start, step_end, count(*) AS n, min(step) AS lo, max(step) AS hi, CAST(sum(event_id) AS BIGINT) AS ids FROM wi GROUP BY 1, 2, 3"
    return f, sql


CATALOGUE["windows_sliding"] = _window_query(14, 7)
CATALOGUE["windows_tumbling"] = _window_query(7, 7)
CATALOGUE["windows_gappy"] = _window_query(2, 5)


@query(f"WITH {EV}, {_windows_sql(30, 15)} SELECT window_id, count(*) AS n FROM wn GROUP BY 1")
def window_row_counts(spark, sf):
    return plain(windows.number_windows(windows.assign_windows(_ev(spark, sf))).groupBy("window_id").agg(F.count("*").alias("n")))


@query(f"WITH {EV} SELECT event_id, step FROM ev WHERE step BETWEEN 5 AND 9")
def filter_window(spark, sf):
    return plain(windows.filter_window(_ev(spark, sf), 5, 9).select("event_id", "step"))


@query(f"WITH {EV}, o AS (SELECT min(step) AS o, max(step) AS m FROM ev), k AS (SELECT o + k * 7 AS a FROM o, (SELECT unnest(range(0, 1000)) AS k) WHERE o + k * 7 <= m) SELECT a AS chunk_start, a + 6 AS chunk_end, count(*) AS n, count(*) FILTER (step >= a) AS own FROM ev JOIN k ON step BETWEEN a - 2 AND a + 6 GROUP BY 1, 2")
def chunk_windows(spark, sf):
    c = windows.chunk_windows(_ev(spark, sf), 7, 2)
    return plain(c.groupBy("chunk_start", "chunk_end").agg(F.count("*").alias("n"), F.count(F.when(F.col("in_chunk"), 1)).alias("own")))


_DICT = "nd AS (SELECT raw_id, row_number() OVER (ORDER BY raw_id) - 1 AS node_id FROM (SELECT src_node AS raw_id FROM ev UNION SELECT dst_node FROM ev))"


@query(f"WITH {EV}, {_DICT} SELECT raw_id, node_id FROM nd")
def node_dictionary(spark, sf):
    return plain(encoding.fit(_ev(spark, sf)))


@query(f"WITH {EV}, a AS (SELECT DISTINCT src_node AS raw_id FROM ev WHERE src_node % 2 = 0), b AS (SELECT raw_id, row_number() OVER (ORDER BY raw_id) - 1 AS node_id FROM a), n AS (SELECT raw_id FROM (SELECT src_node AS raw_id FROM ev UNION SELECT dst_node FROM ev) WHERE raw_id NOT IN (SELECT raw_id FROM a)) SELECT * FROM b UNION ALL SELECT raw_id, row_number() OVER (ORDER BY raw_id) - 1 + (SELECT count(*) FROM b) FROM n")
def node_dictionary_grown(spark, sf):
    ev = _ev(spark, sf)
    known = encoding.fit(ev.where("src_node % 2 = 0"), ("src_node",))
    return plain(encoding.fit(ev, known=known))


@query(f"WITH {EV}, {_DICT} SELECT event_id, a.node_id AS src_node, b.node_id AS dst_node FROM ev JOIN nd a ON a.raw_id = src_node JOIN nd b ON b.raw_id = dst_node")
def encode(spark, sf):
    return plain(encoding.fit_transform(_ev(spark, sf))[0].select("event_id", "src_node", "dst_node"))


@query(CATALOGUE["encode"][1])
def encode_strict(spark, sf):
    """With the dictionary fitted before, and a look for labels that it hasn't."""
    ev = _ev(spark, sf)
    return plain(encoding.transform(ev, encoding.fit(ev), strict=True).select("event_id", "src_node", "dst_node"))


@query(f"WITH {EV} SELECT event_id, CAST(src_node AS VARCHAR) AS label FROM ev")
def decode(spark, sf):
    coded, names = encoding.fit_transform(_ev(spark, sf))
    return plain(encoding.decode(coded.select("event_id", "src_node"), names, "src_node", "label").select("event_id", "label"))


@query(f"WITH {EV} SELECT count(DISTINCT src_node) AS n_src, count(DISTINCT dst_node) AS n_dst, (SELECT count(*) FROM (SELECT src_node FROM ev UNION SELECT dst_node FROM ev)) AS n_nodes FROM ev")
def distinct_nodes(spark, sf):
    ends = _ev(spark, sf).select(F.explode(F.array(F.struct(F.lit(1).alias("o"), F.col("src_node").alias("n")), F.struct(F.lit(0).alias("o"), F.col("dst_node").alias("n")))).alias("e"))
    seen = ends.groupBy(F.col("e.n").alias("n")).agg(F.max(F.col("e.o")).alias("s"), F.max(1 - F.col("e.o")).alias("d"))
    return plain(seen.agg(F.sum("s").alias("n_src"), F.sum("d").alias("n_dst"), F.count("*").alias("n_nodes")))


@query(f"WITH {EV}, d AS (SELECT dst_node AS raw_id, row_number() OVER (ORDER BY dst_node) - 1 AS node_id FROM (SELECT DISTINCT dst_node FROM ev)) SELECT event_id, src_node, node_id AS dst_node FROM ev JOIN d ON raw_id = dst_node")
def encode_column(spark, sf):
    return plain(encoding.encode_column(_ev(spark, sf), "dst_node")[0].select("event_id", "src_node", "dst_node"))


@query(f"WITH {EV} SELECT event_id FROM ev WHERE dst_node IN (SELECT src_node FROM ev WHERE step < 2)")
def contains(spark, sf):
    ev = _ev(spark, sf)
    return plain(encoding.contains(ev, encoding.fit(ev.where("step < 2"), ("src_node",)), "dst_node").select("event_id"))


@query(f"WITH {EV} SELECT CAST(step AS BIGINT) AS step, min(i) AS lo, max(i) AS hi FROM (SELECT step, row_number() OVER (ORDER BY step, amount, dst_node, is_sar, src_node) - 1 AS i FROM ev) GROUP BY 1")
def ordered_ids(spark, sf):
    """Event ids that pass check_ordered(), which raises where steps don't ascend with them."""
    rows = tx.check_ordered(tx.with_event_id(_ev(spark, sf).select("amount", "dst_node", "is_sar", "src_node", "step")))
    return plain(rows.groupBy("step").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")))


# ---- edges ---------------------------------------------------------------------------------------------------------

_RELAY = "rel AS (SELECT a.src_node AS src_1, a.dst_node AS dst_1, a.step AS step_1, a.amount AS amount_1, a.is_sar AS alert_1, b.src_node AS src_2, b.dst_node AS dst_2, b.step AS step_2, b.amount AS amount_2, b.is_sar AS alert_2 FROM ev a JOIN ev b ON a.dst_node = b.src_node AND b.step - a.step BETWEEN 1 AND 5)"
_RELAY_SQL = f"WITH {EV}, {_RELAY} SELECT src_1, dst_1, step_1, round(amount_1, 6) AS amount_1, CAST(alert_1 AS BIGINT) AS alert_1, src_2, dst_2, step_2, round(amount_2, 6) AS amount_2, CAST(alert_2 AS BIGINT) AS alert_2 FROM rel"


@query(_RELAY_SQL)
def temporal_edges(spark, sf):
    return plain(edges.temporal_edges(_ev(spark, sf)))


@query(_RELAY_SQL)
def temporal_edges_bucketed(spark, sf):
    return plain(edges.temporal_edges(_ev(spark, sf), bucketed=True))


@query(f"WITH {CP} SELECT a.src_node AS src_1, a.dst_node AS dst_1, a.step AS step_1, b.dst_node AS dst_2, b.step AS step_2, round(CAST(b.amount AS DOUBLE), 2) AS amount_2 FROM cp a JOIN cp b ON a.dst_node = b.src_node AND b.step - a.step BETWEEN 1 AND 5")
def temporal_edges_sparse(spark, sf):
    return plain(edges.temporal_edges(views.order_flows(spark, sf)).select("src_1", "dst_1", "step_1", "dst_2", "step_2", "amount_2"), 2)


@query(f"WITH {EV}, {_windows_sql(14, 7)} SELECT a.window_id, count(*) AS n FROM wn a JOIN wn b ON a.window_id = b.window_id AND a.dst_node = b.src_node AND b.step - a.step BETWEEN 1 AND 5 GROUP BY 1")
def temporal_edges_count_by_window(spark, sf):
    w = windows.number_windows(windows.assign_windows(_ev(spark, sf), 14, 7))
    return plain(edges.temporal_edges(w, 5, ("window_id",)).groupBy("window_id").agg(F.count("*").alias("n")))


_SNAP = "snap AS (SELECT src_node, dst_node, sum(amount) AS weight, count(*) AS tx_count, min(step) AS step_min, max(step) AS step_max FROM ev GROUP BY 1, 2)"


@query(f"WITH {EV}, {_SNAP} SELECT src_node, dst_node, round(weight, 4) AS weight, tx_count, step_min, step_max FROM snap")
def snapshot_edges(spark, sf):
    return plain(edges.snapshot_edges(_ev(spark, sf)), 4)


@query(f"WITH {EV}, {_windows_sql(14, 7)} SELECT window_id, src_node, dst_node, round(sum(amount), 4) AS weight, count(*) AS tx_count, min(step) AS step_min, max(step) AS step_max FROM wn GROUP BY 1, 2, 3")
def snapshot_edges_by_window(spark, sf):
    return plain(edges.snapshot_edges(windows.number_windows(windows.assign_windows(_ev(spark, sf), 14, 7)), ("window_id",)), 4)


@query(f"WITH {EV}, {_RELAY} SELECT src_1 AS src_2nd, dst_2 AS dst_2nd, count(*) AS count, round(sum(amount_1), 4) AS weight_src, round(sum(amount_2), 4) AS weight_dst, round(avg(step_2 - step_1), 4) AS avg_gap, CAST(sum(alert_1 + alert_2) AS BIGINT) AS n_alert FROM rel WHERE src_1 <> dst_2 GROUP BY 1, 2")
def second_order_edges(spark, sf):
    return plain(edges.second_order_edges(edges.temporal_edges(_ev(spark, sf))), 4)


@query(f"WITH {EV} SELECT src_node AS i, dst_node AS j, round(sum(amount), 4) AS w FROM ev GROUP BY 1, 2")
def adjacency(spark, sf):
    return plain(_matrix(spark, sf), 4)


def _matrix(spark, sf):
    return edges.adjacency(edges.snapshot_edges(_ev(spark, sf)))


@query(f"WITH {EV} SELECT node, round(sum(o), 4) AS d_out, round(sum(n), 4) AS d_in FROM (SELECT src_node AS node, amount AS o, 0.0 AS n FROM ev UNION ALL SELECT dst_node, 0.0, amount FROM ev) GROUP BY 1")
def adjacency_degrees(spark, sf):
    return plain(edges.degrees(_matrix(spark, sf)), 4)


@query(f"WITH {EV} SELECT max(greatest(src_node, dst_node)) + 1 AS n_nodes FROM ev")
def node_count(spark, sf):
    return plain(edges.node_count(_matrix(spark, sf)))


@query(f"WITH {EV}, {_windows_sql(14, 7)}, s AS (SELECT window_id, src_node, dst_node, sum(amount) AS w FROM wn GROUP BY 1, 2, 3) SELECT s.window_id, round(sum(w), 4) AS m_t, count(*) AS n_edges, any_value(n_active) AS n_active FROM s JOIN (SELECT window_id, count(DISTINCT node) AS n_active FROM (SELECT window_id, src_node AS node FROM wn UNION ALL SELECT window_id, dst_node FROM wn) GROUP BY 1) a ON a.window_id = s.window_id GROUP BY 1")
def window_graph(spark, sf):
    w = windows.number_windows(windows.assign_windows(_ev(spark, sf), 14, 7))
    return plain(edges.window_stats(edges.adjacency(edges.snapshot_edges(w, ("window_id",)), ("window_id",)), ("window_id",)), 4)


@query(f"WITH {EV} SELECT i, j, round(sum(w) / 2, 4) AS w FROM (SELECT src_node AS i, dst_node AS j, amount AS w FROM ev UNION ALL SELECT dst_node, src_node, amount FROM ev) GROUP BY 1, 2")
def symmetrize(spark, sf):
    return plain(edges.symmetrize(_matrix(spark, sf)), 4)


@query(f"WITH {EV} SELECT src_node AS node FROM ev UNION SELECT dst_node FROM ev")
def active_nodes(spark, sf):
    return plain(edges.active_nodes(_matrix(spark, sf)))


@query(f"WITH {EV}, {_SNAP} SELECT src_node, dst_node, round(sum(weight), 4) AS weight, CAST(sum(tx_count) AS BIGINT) AS tx_count FROM snap GROUP BY 1, 2")
def relay_edges(spark, sf):
    return plain(edges.relay_edges(edges.snapshot_edges(_ev(spark, sf))), 4)


_BY_WINDOW = f"{_windows_sql(14, 7)}, sw AS (SELECT window_id, src_node, dst_node, sum(amount) AS weight FROM wn GROUP BY 1, 2, 3)"


@query(f"WITH {EV}, {_BY_WINDOW} SELECT src_node, dst_node, round(sum(weight), 4) AS weight, count(*) AS tx_count FROM sw GROUP BY 1, 2")
def relay_edges_rows(spark, sf):
    """Snapshot edges of all windows met, counted as rows: the windows that an edge is in."""
    w = windows.number_windows(windows.assign_windows(_ev(spark, sf), 14, 7))
    return plain(edges.relay_edges(edges.snapshot_edges(w, ("window_id",)), count_rows=True), 4)


_PLAN = f"""{EV}, {_DICT}, en AS (SELECT a.node_id AS src_node, b.node_id AS dst_node, step, amount, is_sar FROM ev JOIN nd a ON a.raw_id = src_node JOIN nd b ON b.raw_id = dst_node), {_windows_sql(30, 15, 'en')},
rel AS (SELECT a.window_id, a.src_node AS src_2nd, b.dst_node AS dst_2nd, a.amount AS x, b.amount AS y FROM wn a JOIN wn b ON a.window_id = b.window_id AND a.dst_node = b.src_node AND b.step - a.step BETWEEN 1 AND 5 AND a.src_node <> b.dst_node)
SELECT window_id, src_2nd, dst_2nd, count(*) AS count, round(sum(x), 4) AS weight_src, round(sum(y), 4) AS weight_dst FROM rel"""


def _second_order(result) -> DataFrame:
    return plain(result.second_order_edges.select("window_id", "src_2nd", "dst_2nd", "count", "weight_src", "weight_dst"), 4)


@query(f"WITH {_PLAN} GROUP BY 1, 2, 3")
def graph_pipeline(spark, sf):
    return _second_order(pipelines.graph_pipeline(_ev(spark, sf)))


@query(f"WITH {_PLAN} WHERE window_id = 0 GROUP BY 1, 2, 3")
def graph_pipeline_first_window(spark, sf):
    return _second_order(pipelines.graph_pipeline(_ev(spark, sf), all_windows=False))


# ---- motifs --------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {EV}, {_fan_sql('dst_node', 'src_node')} {_motif_sql('fan', 'fanin', 'list_append(sr, x)', quotient=True)}")
def motif_fanin(spark, sf):
    return plain_motifs(motifs.find_fanin(_ev(spark, sf)))


@query(f"WITH RECURSIVE {EV}, {_fan_sql('src_node', 'dst_node')} {_motif_sql('fan', 'fanout', 'list_prepend(x, sr)', quotient=True)}")
def motif_fanout(spark, sf):
    return plain_motifs(motifs.find_fanout(_ev(spark, sf)))


@query(f"WITH RECURSIVE {EV}, {_fan_sql('dst_node', 'src_node')}, one AS (SELECT * FROM fan QUALIFY row_number() OVER (PARTITION BY x, list_sort(sr) ORDER BY st[1], ed[1]) = 1) {_motif_sql('one', 'fanin', 'list_append(sr, x)', quotient=True)}")
def motif_fanin_dedup(spark, sf):
    return plain_motifs(motifs.find_fanin(_ev(spark, sf), MotifConfig(dedup_fanin=True)))


@query(f"WITH {EV}, m AS ({_chain_sql(True)}) {_motif_sql('m', 'cycle3', '[u, v, w, u]')}")
def motif_cycle3(spark, sf):
    return plain_motifs(motifs.find_cycle3(_ev(spark, sf)))


@query(f"WITH {EV}, m AS ({_chain_sql(False)}) {_motif_sql('m', 'relay4', '[u, v, w, x]', quotient=True)}")
def motif_relay4(spark, sf):
    return plain_motifs(motifs.find_relay4(_ev(spark, sf)))


@query(f"WITH {EV}, {_split_sql()} {_motif_sql('sm', 'split_merge', '[u, v, w, x]')}")
def motif_split_merge(spark, sf):
    return plain_motifs(motifs.find_split_merge(_ev(spark, sf)))


@query(f"WITH {EV}, {_split_sql(strict=True)} {_motif_sql('sm', 'split_merge', '[u, v, w, x]')}")
def motif_split_merge_strict(spark, sf):
    return plain_motifs(motifs.find_split_merge(_ev(spark, sf), MotifConfig(strict_chronology=True)))


@query(f"WITH {EV}, {_split_sql(first=True)} {_motif_sql('sm', 'split_merge', '[u, v, w, x]')}")
def motif_split_merge_first_edge(spark, sf):
    return plain_motifs(motifs.find_split_merge(_ev(spark, sf), MotifConfig(first_edge_only=True)))


@query(f"WITH {EV}, n AS (SELECT src_node, count(*) AS n FROM ev GROUP BY 1) SELECT event_id FROM ev WHERE src_node NOT IN (SELECT src_node FROM n WHERE n > (SELECT CAST(floor(quantile_cont(n, 0.95)) AS BIGINT) FROM n))")
def hub_prune(spark, sf):
    return plain(motifs.hub_prune(_ev(spark, sf)).select("event_id"))


@query(f"WITH RECURSIVE {EV}, {_all_motifs()} SELECT motif_type, count(*) AS support FROM found GROUP BY 1")
def motif_support(spark, sf):
    return plain(significance.count_support(motifs.run_all(_ev(spark, sf))))


@query(f"WITH RECURSIVE {EV}, {_all_motifs()}, r AS (SELECT *, row_number() OVER (PARTITION BY motif_type ORDER BY list_min(st), {_text('ed')}) AS r FROM found WHERE motif_type IN ('cycle3', 'fanout')) SELECT motif_type, {_text('ed')} AS edges FROM r WHERE r <= 100")
def motif_enabled_first(spark, sf):
    """Two types alone, the first 100 instances of each: the options enabled and max_instances."""
    return plain(motifs.run_all(_ev(spark, sf), MotifConfig(enabled=("fanout", "cycle3"), max_instances=100)).select("motif_type", "edges"))


@query(f"WITH RECURSIVE {EV}, {_all_motifs()} SELECT CAST(list_min(st) // 7 * 7 AS BIGINT) AS window_start, motif_type, count(*) AS n FROM found GROUP BY 1, 2")
def motif_pipeline(spark, sf):
    """Instances of the motif plan that its default filter keeps, by window."""
    kept = pipelines.motif_pipeline(_ev(spark, sf)).kept
    start = (F.floor(F.array_min("steps") / F.lit(7)) * 7).alias("window_start")
    return plain(kept.groupBy(start, "motif_type").agg(F.count("*").alias("n")))


_STRICT = MotifConfig(r_min_cycle=1000, r_min_split_merge=1000)


@query(f"WITH RECURSIVE {EV}, {_all_motifs()}, s AS (SELECT motif_type, count(*) AS n FROM found GROUP BY 1) SELECT motif_type, {_text('ed')} AS edges FROM found WHERE motif_type IN (SELECT motif_type FROM s WHERE n >= CASE WHEN motif_type IN ('cycle3', 'split_merge') THEN 1000 ELSE 1 END)")
def motif_filter(spark, sf):
    return plain(significance.filter_motifs(motifs.run_all(_ev(spark, sf)), _STRICT).select("motif_type", "edges"))


_PERM = """pm AS (SELECT ev.*, perm_id, row_number() OVER (PARTITION BY perm_id, src_node ORDER BY step, event_id) AS a,
  row_number() OVER (PARTITION BY perm_id, src_node ORDER BY md5('42-' || perm_id || '-' || event_id), event_id) AS b FROM ev, (SELECT unnest(range(0, {n})) AS perm_id)),
sh AS (SELECT x.perm_id, x.event_id, x.src_node, x.dst_node, x.amount, x.is_sar, y.step FROM pm x JOIN pm y ON x.perm_id = y.perm_id AND x.src_node = y.src_node AND x.a = y.b)"""


@query(f"WITH {EV}, {_PERM.format(n=3)} SELECT perm_id, event_id, src_node, step FROM sh")
def null_shuffle(spark, sf):
    return plain(significance.shuffle_steps(_ev(spark, sf), 3).select("perm_id", "event_id", "src_node", "step"))


@query(f"""WITH RECURSIVE {EV}, {_PERM.format(n=2)}, {_all_motifs('sh', ('perm_id',))}, nul AS (SELECT motif_type, perm_id, count(*) AS n FROM found GROUP BY 1, 2),
grid AS (SELECT t, p, coalesce(n, 0) AS n FROM (SELECT unnest(['fanin', 'fanout', 'cycle3', 'relay4', 'split_merge']) AS t) CROSS JOIN (SELECT unnest(range(0, 2)) AS p) LEFT JOIN nul ON motif_type = t AND perm_id = p)
SELECT t AS motif_type, round(avg(n), 2) AS null_mean, round(stddev_pop(n), 2) AS null_std FROM grid GROUP BY 1""")
def null_zscore(spark, sf):
    ev = _ev(spark, sf)
    return plain(significance.null_zscore(motifs.run_all(ev), ev, n_permutations=2).select("motif_type", "null_mean", "null_std"))


@query(f"""WITH RECURSIVE {EV}, {_PERM.format(n=2)}, {_all_motifs('sh', ('perm_id',))}, nul AS (SELECT motif_type, perm_id, least(count(*), 400) AS n FROM found GROUP BY 1, 2),
grid AS (SELECT t, p, coalesce(n, 0) AS n FROM (SELECT unnest(['fanin', 'fanout', 'cycle3', 'relay4', 'split_merge']) AS t) CROSS JOIN (SELECT unnest(range(0, 2)) AS p) LEFT JOIN nul ON motif_type = t AND perm_id = p),
ob AS (WITH RECURSIVE {_all_motifs()} SELECT motif_type, count(*) AS n FROM found GROUP BY 1)
SELECT t AS motif_type, max(coalesce(ob.n, 0)) AS observed, round(avg(grid.n), 2) AS null_mean, round(stddev_pop(grid.n), 2) AS null_std FROM grid LEFT JOIN ob ON motif_type = t GROUP BY 1""")
def null_zscore_capped(spark, sf):
    """The cost control null_cap: a type counts 400 instances a permutation at most."""
    ev = _ev(spark, sf)
    return plain(significance.null_zscore(motifs.run_all(ev), ev, n_permutations=2, null_cap=400).select("motif_type", "observed", "null_mean", "null_std"))


_ZSCORE = f"""WITH RECURSIVE {_PERM.format(n=MotifConfig().n_permutations)}, {_all_motifs('sh', ('perm_id',))}, nul AS (SELECT motif_type, perm_id, count(*) AS n FROM found GROUP BY 1, 2),
grid AS (SELECT t, p, coalesce(n, 0) AS n FROM (SELECT unnest(['fanin', 'fanout', 'cycle3', 'relay4', 'split_merge']) AS t) CROSS JOIN (SELECT unnest(range(0, {MotifConfig().n_permutations})) AS p) LEFT JOIN nul ON motif_type = t AND perm_id = p),
nm AS (SELECT t AS motif_type, avg(n) AS m, stddev_pop(n) AS s FROM grid GROUP BY 1),
ob AS (WITH RECURSIVE {_all_motifs()} SELECT motif_type, count(*) AS n FROM found GROUP BY 1)
SELECT motif_type, coalesce(n, 0) AS observed, round(m, 2) AS null_mean, round(s, 2) AS null_std, round((coalesce(n, 0) - m) / (s + 1e-9), 3) AS zscore FROM nm LEFT JOIN ob USING (motif_type)"""


@query(f"WITH {EV}, z AS ({_ZSCORE}) SELECT * FROM z")
def motif_zscore(spark, sf):
    """Real support against the production number of permutations; null_zscore has the null columns of two."""
    ev = _ev(spark, sf)
    return plain(significance.null_zscore(motifs.run_all(ev), ev))


@query(f"WITH RECURSIVE {EV}, zs AS ({_ZSCORE}), {_all_motifs()} SELECT motif_type, {_text('ed')} AS edges FROM found JOIN zs USING (motif_type) WHERE zscore >= -1.1")
def motif_filter_z(spark, sf):
    """Instances of types that the z-scored run of the motif plan keeps, at a bound that some types reach."""
    return plain(pipelines.motif_pipeline(_ev(spark, sf), MotifConfig(z_min=-1.1), with_zscores=True).kept.select("motif_type", "edges"))


_STATS = """fs AS (SELECT *, list_transform(range(2, len(st) + 1), lambda i: st[i] - st[i - 1]) AS lg, list_transform(range(2, len(st) + 1), lambda i: round(am[i] / am[i - 1], 4)) AS rt FROM found),
en AS (SELECT motif_type, unnest(list_distinct(nd)) AS node, CAST(round(list_avg(am) * 1e6) AS HUGEINT) AS aa, CAST(round(list_avg(rt) * 1e9) AS HUGEINT) AS ar, CAST(round(list_stddev_pop(rt) * 1e9) AS HUGEINT) AS rs,
  CAST(round(list_avg(lg) * 1e9) AS HUGEINT) AS al_, list_max(lg) AS ml, CAST(list_sum(al) AS BIGINT) AS na FROM fs),
ef AS (SELECT node, motif_type, count(*) AS count, CAST(max(ml) AS DOUBLE) AS max_lag, any_value(coalesce(dg, 1)) AS dg, count(*) / (SELECT sum(amount) FROM ev) AS freq_by_volume,
  sum(aa) AS s_avg_amount, count(aa) AS n_avg_amount, sum(ar) AS s_avg_ratio, count(ar) AS n_avg_ratio, sum(rs) AS s_ratio_std, count(rs) AS n_ratio_std, sum(al_) AS s_avg_lag, count(al_) AS n_avg_lag, sum(na) AS s_avg_n_alert_edges, count(na) AS n_avg_n_alert_edges
  FROM en LEFT JOIN (SELECT src_node, count(*) AS dg FROM ev GROUP BY 1) d ON d.src_node = node GROUP BY 1, 2)"""
# Means as whole numbers: their sum, count and scale, so that rounding half up is exact.
_MEANS = {"avg_amount": 10**6, "avg_ratio": 10**9, "ratio_std": 10**9, "avg_lag": 10**9, "avg_n_alert_edges": 1}


def _half_up(total: str, n: str, scale: int, places: int) -> str:
    return f"CAST((2 * CAST({total} AS HUGEINT) * {10**places} + {n} * {scale}) // (2 * {n} * {scale}) AS DOUBLE) / {10**places}"


def _metric(c: str, places: int) -> str:
    """SQL of a metric of ef, rounded."""
    if c in _MEANS:
        return _half_up(f"s_{c}", f"n_{c}", _MEANS[c], places)
    return _half_up("count", "dg", 1, places) if c == "freq_by_degree" else c


_EF = ("avg_amount", "avg_ratio", "ratio_std", "avg_lag", "max_lag", "avg_n_alert_edges", "freq_by_degree")


def _entity(spark, sf, zscores: bool = False):
    ev = _ev(spark, sf)
    found = motifs.run_all(ev)
    found = settled(found) if zscores else found  # read twice then
    return features.entity_features(found, significance.null_zscore(found, ev) if zscores else None, features.node_degrees(ev), ev.select(F.sum("amount").alias("v")).scalar())


@query(f"WITH RECURSIVE {EV}, {_all_motifs()}, {_STATS} SELECT node, motif_type, count, {', '.join(f'{_metric(c, 6)} AS {c}' for c in _EF)}, round(freq_by_volume * 1000000, 3) AS freq_by_volume_million FROM ef")
def entity_features(spark, sf):
    e = _entity(spark, sf).withColumn("freq_by_volume_million", F.round(F.col("freq_by_volume") * 1000000, 3)).drop("zscore", "freq_by_volume")
    return plain(e)


def _wide_sql(motif: str, metric: str) -> str:
    mine = f"FILTER (motif_type = '{motif}')"
    if metric == "count":
        return f"CAST(coalesce(max(count) {mine}, 0) AS BIGINT)"
    if metric == "freq_by_volume":
        return f"round(coalesce(max(freq_by_volume) {mine}, 0) * 1000000, 3)"
    return f"coalesce(max({_metric(metric, 4)}) {mine}, 0)"


@query(f"WITH RECURSIVE {EV}, zs AS ({_ZSCORE}), {_all_motifs()}, {_STATS}, ez AS (SELECT ef.*, zscore FROM ef LEFT JOIN zs USING (motif_type)) SELECT node, " + ", ".join(f"{_wide_sql(m, c)} AS {m}_{c}" for m in motifs.MATCHERS for c in features.WIDE_METRICS) + " FROM ez GROUP BY 1")
def entity_wide(spark, sf):
    """All ten metrics of all types, freq_by_volume in millionths."""
    wide = features.entity_wide(_entity(spark, sf, zscores=True))
    return plain(wide.withColumns({f"{m}_freq_by_volume": F.round(F.col(f"{m}_freq_by_volume") * 1000000, 3) for m in motifs.MATCHERS}), 4)


@query(f"WITH RECURSIVE {EV}, {_all_motifs()}, {_STATS} SELECT CAST(list_min(st) // 7 * 7 AS BIGINT) AS window_start, motif_type, count(*) AS count, round(sum(list_sum(am)), 2) AS total_amount, {_half_up('sum(CAST(round(list_avg(lg) * 1e9) AS HUGEINT))', 'count(*)', 10**9, 2)} AS avg_lag, CAST(sum(list_sum(al)) AS BIGINT) AS n_alert_edges, round(avg(CASE WHEN list_sum(al) > 0 THEN 1.0 ELSE 0.0 END), 2) AS suspicious_ratio FROM fs GROUP BY 1, 2")
def window_features(spark, sf):
    return plain(features.window_features(motifs.run_all(_ev(spark, sf))), 2)


# ---- communities ---------------------------------------------------------------------------------------------------

_WEIGHT = f"""{_SNAP}, wt AS (SELECT src_node, dst_node, weight * exp(-abs(ln(node_out / (node_in + 1e-9) + 1e-9))) AS weight, node_out, node_in FROM
  (SELECT *, sum(weight) OVER (PARTITION BY src_node) AS node_out, sum(weight) OVER (PARTITION BY dst_node) AS node_in FROM snap))"""


@query(f"WITH {EV}, {_WEIGHT} SELECT src_node, dst_node, round(weight, 4) AS weight, round(node_out, 4) AS node_out, round(node_in, 4) AS node_in FROM wt WHERE weight >= 0.01")
def edge_weighting(spark, sf):
    return plain(com.apply_weighting(edges.snapshot_edges(_ev(spark, sf)), sparsify=False).select("src_node", "dst_node", "weight", "node_out", "node_in"), 4)


@query(f"WITH {EV}, {_WEIGHT} SELECT src_node, dst_node, round(weight, 4) AS weight FROM wt WHERE weight >= 0.01 QUALIFY row_number() OVER (PARTITION BY src_node ORDER BY weight DESC, dst_node) <= 10")
def topk_neighbors(spark, sf):
    return plain(com.apply_weighting(edges.snapshot_edges(_ev(spark, sf))).select("src_node", "dst_node", "weight"), 4)


_FACTOR = "exp(-abs(ln(node_out / (node_in + 1e-9) + 1e-9)))"


@query(f"""WITH {EV}, {_RELAY}, so AS (SELECT src_1 AS src_node, dst_2 AS dst_node, sum(amount_1) AS weight, avg(step_2 - step_1) AS avg_gap FROM rel WHERE src_1 <> dst_2 GROUP BY 1, 2),
wt AS (SELECT *, sum(weight) OVER (PARTITION BY src_node) AS node_out, sum(weight) OVER (PARTITION BY dst_node) AS node_in FROM so), ww AS (SELECT src_node, dst_node, weight * {_FACTOR} * exp(-0.5 * avg_gap / 5) AS weight FROM wt)
SELECT src_node, dst_node, round(weight, 4) AS weight FROM ww WHERE weight >= 0.01""")
def edge_weighting_gap(spark, sf):
    """Second-order edges, whose mean gap makes the time factor."""
    second = edges.second_order_edges(edges.temporal_edges(_ev(spark, sf)))
    second = second.select(F.col("src_2nd").alias("src_node"), F.col("dst_2nd").alias("dst_node"), F.col("weight_src").alias("weight"), "avg_gap")
    return plain(com.apply_weighting(second, delta_w=5, sparsify=False).select("src_node", "dst_node", "weight"), 4)


@query(f"""WITH {EV}, {_BY_WINDOW}, wt AS (SELECT *, sum(weight) OVER (PARTITION BY window_id, src_node) AS node_out, sum(weight) OVER (PARTITION BY window_id, dst_node) AS node_in FROM sw),
ww AS (SELECT window_id, src_node, dst_node, weight * {_FACTOR} AS w FROM wt), kept AS (SELECT * FROM ww WHERE w >= 0.01 QUALIFY row_number() OVER (PARTITION BY window_id, src_node ORDER BY w DESC, dst_node) <= 10),
n AS (SELECT window_id, count(DISTINCT node) AS n_active FROM (SELECT window_id, src_node AS node FROM kept UNION ALL SELECT window_id, dst_node FROM kept) GROUP BY 1)
SELECT window_id, round(sum(w), 4) AS m_t, count(*) AS n_edges, any_value(n_active) AS n_active FROM kept JOIN n USING (window_id) GROUP BY 1""")
def window_graph_weighted(spark, sf):
    """Window graphs of weighted edges, the ten best of each source."""
    keys = ("window_id",)
    w = windows.number_windows(windows.assign_windows(_ev(spark, sf), 14, 7))
    return plain(edges.window_stats(edges.adjacency(com.apply_weighting(edges.snapshot_edges(w, keys), keys=keys), keys), keys), 4)


_LABELS = f"""{_windows_sql(10, 10)}, lb AS (SELECT DISTINCT window_id, node, CASE WHEN node % 20 = 19 THEN -1 ELSE node % 20 END AS global_cid FROM (SELECT window_id, src_node AS node FROM wn UNION ALL SELECT window_id, dst_node FROM wn))"""
_KEYS = ("window_id",)


def _stand_in(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(windowed events, labels by node number): a community rule that needs no clustering."""
    w = settled(windows.number_windows(windows.assign_windows(_ev(spark, sf), 10, 10)))
    nodes = w.select("window_id", F.explode(F.array("src_node", "dst_node")).alias("node")).distinct()
    return w, nodes.withColumn("global_cid", F.when(F.col("node") % 20 == 19, F.lit(-1)).otherwise(F.col("node") % 20).cast("bigint"))


@query(f"WITH {EV}, {_LABELS}, n AS (SELECT *, count(*) OVER (PARTITION BY window_id, global_cid) AS n FROM lb) SELECT window_id, node, CASE WHEN n < 8 THEN -1 ELSE global_cid END AS community_id FROM n")
def small_community_filter(spark, sf):
    labels = _stand_in(spark, sf)[1].withColumnRenamed("global_cid", "community_id")
    return plain(com.drop_small(labels, CommunityConfig(min_comm_size=8)))


_ROLES = """e AS (SELECT window_id, src_node AS node, amount AS o, 0.0 AS i, is_sar FROM wn UNION ALL SELECT window_id, dst_node, 0.0, amount, is_sar FROM wn),
r0 AS (SELECT window_id, node, sum(o) AS o, sum(i) AS i, count(*) AS n_tx, CAST(sum(is_sar) AS BIGINT) AS n_alert_tx FROM e GROUP BY 1, 2),
r1 AS (SELECT *, (o - i) / (o + i + 1e-9) AS net, 2 * least(o, i) / (o + i + 1e-9) AS even FROM r0),
rl AS (SELECT window_id, node, o, i, n_tx, n_alert_tx, net, even, even * (1 - abs(net)) AS layering_score, CASE WHEN even > 0.8 AND abs(net) < 0.3 * 0.67 THEN 3 WHEN net < -0.3 THEN 2 WHEN net > 0.3 THEN 1 ELSE 0 END AS role FROM r1)"""


@query(f"WITH {EV}, {_windows_sql(10, 10)}, {_ROLES} SELECT window_id, node, round(o + i, 4) AS total_volume, round(o, 4) AS total_volume_out, round(i, 4) AS total_volume_in, n_tx, n_alert_tx, round(n_alert_tx / (n_tx + 1e-9), 4) AS alert_rate, round(net, 4) AS net_flow_ratio, round(even, 4) AS flow_consistency, round(layering_score, 4) AS layering_score, CAST(role AS BIGINT) AS role FROM rl")
def node_roles(spark, sf):
    w, _ = _stand_in(spark, sf)
    return plain(com.node_roles(w, keys=_KEYS), 4)


_FEATURES = f"""{_LABELS}, {_ROLES}, le AS (SELECT x.*, a.global_cid AS sc, b.global_cid AS dc FROM (SELECT window_id, src_node, dst_node, sum(amount) AS weight, sum(is_sar) AS n_alert FROM wn GROUP BY 1, 2, 3) x
  JOIN lb a ON a.window_id = x.window_id AND a.node = src_node AND a.global_cid <> -1 JOIN lb b ON b.window_id = x.window_id AND b.node = dst_node AND b.global_cid <> -1),
tt AS (SELECT window_id, sum(weight) AS total FROM le GROUP BY 1),
cb AS (SELECT window_id, sc AS global_cid, sum(weight) FILTER (sc = dc) AS total_volume, count(*) FILTER (sc = dc) AS n_internal_edges, avg(CASE WHEN n_alert > 0 THEN 1.0 ELSE 0.0 END) FILTER (sc = dc) AS alert_ratio, coalesce(sum(weight) FILTER (sc <> dc), 0) AS ext FROM le GROUP BY 1, 2 HAVING count(*) FILTER (sc = dc) > 0),
rc AS (SELECT a.window_id, a.sc AS global_cid, sum(a.weight) AS back FROM le a JOIN le b ON a.window_id = b.window_id AND a.src_node = b.dst_node AND a.dst_node = b.src_node AND a.sc = a.dc GROUP BY 1, 2),
si AS (SELECT window_id, global_cid, max(v) / (sum(v) + 1e-9) AS sink FROM (SELECT window_id, sc AS global_cid, dst_node, sum(weight) AS v FROM le WHERE sc = dc GROUP BY 1, 2, 3) GROUP BY 1, 2),
so AS (SELECT window_id, global_cid, max(v) / (sum(v) + 1e-9) AS source FROM (SELECT window_id, sc AS global_cid, src_node, sum(weight) AS v FROM le WHERE sc = dc GROUP BY 1, 2, 3) GROUP BY 1, 2),
sz AS (SELECT lb.window_id, global_cid, count(*) AS size, count(*) FILTER (role = 1) AS n_sources, count(*) FILTER (role = 2) AS n_sinks, count(*) FILTER (role = 3) AS n_layering, avg(layering_score) AS avg_layering_score FROM lb LEFT JOIN rl ON rl.window_id = lb.window_id AND rl.node = lb.node WHERE global_cid <> -1 GROUP BY 1, 2),
cf AS (SELECT cb.window_id, cb.global_cid, size, total_volume / (total + 1e-9) AS internal_flow, ext / (total + 1e-9) AS external_flow, coalesce(back, 0) / (total_volume + 1e-9) AS reciprocity, sink AS sink_concentration, source AS source_concentration, n_sources, n_sinks, n_layering, avg_layering_score, total_volume, n_internal_edges, alert_ratio,
  total_volume / (size + 1e-9) AS vol_density, n_internal_edges / (size * (size - 1) + 1e-9) AS edge_density FROM cb JOIN tt USING (window_id) LEFT JOIN rc USING (window_id, global_cid) JOIN si USING (window_id, global_cid) JOIN so USING (window_id, global_cid) JOIN sz USING (window_id, global_cid))"""
_CF = ("internal_flow", "external_flow", "reciprocity", "sink_concentration", "source_concentration", "avg_layering_score", "total_volume", "alert_ratio", "vol_density", "edge_density")


_RELAYS = ("relay4",)


def _features(spark, sf, types: tuple[str, ...] = ()) -> DataFrame:
    w, labels = _stand_in(spark, sf)
    counts = None
    if types:
        counts = com.motif_counts_within(w, labels, MotifConfig(enabled=types), _KEYS)
    return com.community_features(w, labels, com.node_roles(w, keys=_KEYS), counts, _KEYS)


def _some(*names: str):
    cols = ["window_id", "global_cid", *names]

    def f(spark, sf):
        return plain(_features(spark, sf).select(*cols), 4)

    sql = f"WITH {EV}, {_FEATURES} SELECT window_id, CAST(global_cid AS BIGINT) AS global_cid, " + ", ".join(f"round({'external_flow' if c == 'external_noise' else 'reciprocity' if c == 'internal_recirc' else c}, 4) AS {c}" if c in (*_CF, "external_noise", "internal_recirc") else c for c in names) + " FROM cf"
    return f, sql


CATALOGUE["community_internal_external"] = _some("total_volume", "n_internal_edges", "alert_ratio", "internal_flow", "external_flow", "external_noise")
CATALOGUE["community_reciprocity"] = _some("reciprocity", "internal_recirc")
CATALOGUE["community_concentration"] = _some("sink_concentration", "source_concentration")
CATALOGUE["community_role_counts"] = _some("size", "n_sources", "n_sinks", "n_layering", "avg_layering_score")
CATALOGUE["community_features"] = _some("size", "n_sources", "n_sinks", "n_layering", "n_internal_edges", *_CF)

_MOTIF_COUNT = f"""m AS ({_chain_sql(False, 'wn', _KEYS)}), mc AS (SELECT window_id, cid AS global_cid, count(*) AS n FROM (SELECT m.window_id, a.global_cid AS cid FROM m JOIN lb a ON a.window_id = m.window_id AND a.node = u JOIN lb b ON b.window_id = m.window_id AND b.node = v AND b.global_cid = a.global_cid
  JOIN lb c ON c.window_id = m.window_id AND c.node = w AND c.global_cid = a.global_cid JOIN lb d ON d.window_id = m.window_id AND d.node = x AND d.global_cid = a.global_cid WHERE a.global_cid <> -1) GROUP BY 1, 2)"""


@query(f"WITH {EV}, {_FEATURES}, {_MOTIF_COUNT} SELECT window_id, CAST(global_cid AS BIGINT) AS global_cid, round(coalesce(n, 0) / size, 4) AS motif_enrichment FROM cf LEFT JOIN mc USING (window_id, global_cid)")
def motif_enrichment(spark, sf, types=_RELAYS):
    return plain(_features(spark, sf, types).select("window_id", "global_cid", "motif_enrichment"), 4)


_SCORE = f"""ps AS (SELECT global_cid, count(DISTINCT window_id) AS n_windows FROM lb WHERE global_cid <> -1 GROUP BY 1), nw AS (SELECT count(DISTINCT window_id) AS n FROM wn),
sc AS (SELECT cf.window_id, cf.global_cid, alert_ratio, internal_flow, reciprocity, external_flow, size, least(1.0, n_windows / nw.n) AS persistence_norm, coalesce(mc.n, 0) / size AS motif_enrichment FROM cf JOIN ps USING (global_cid) LEFT JOIN mc USING (window_id, global_cid), nw),
sd AS (SELECT *, motif_enrichment / CASE WHEN (SELECT max(motif_enrichment) FROM sc) > 0 THEN (SELECT max(motif_enrichment) FROM sc) ELSE 1 END AS motif_enrichment_norm FROM sc),
sr AS (SELECT *, greatest(0, 0.30 * least(1, internal_flow) + 0.20 * least(1, reciprocity) + 0.25 * persistence_norm + 0.15 * motif_enrichment_norm - 0.10 * least(1, external_flow) - 0.05 * ln(1 + size)) AS suspicion_score FROM sd)"""
_LOW = CommunityConfig(global_susp_threshold=0.15)


def _scored(spark, sf, cfg=_LOW, types=_RELAYS) -> DataFrame:
    w, labels = _stand_in(spark, sf)
    total = w.select(F.countDistinct("window_id").alias("n")).scalar()
    return com.score_communities(settled(_features(spark, sf, types)), cfg, tracking.persistence(labels), total)


@query(f"WITH {EV}, {_FEATURES}, {_MOTIF_COUNT}, {_SCORE} SELECT window_id, CAST(global_cid AS BIGINT) AS global_cid, round(suspicion_score, 4) AS suspicion_score, round(persistence_norm, 4) AS persistence_norm, round(motif_enrichment_norm, 4) AS motif_enrichment_norm, CAST(suspicion_score >= 0.15 AS BIGINT) AS is_suspicious, CAST(internal_flow >= 0.5 AS BIGINT) AS flag_internal_flow, CAST(reciprocity >= 0.3 AS BIGINT) AS flag_reciprocity, CAST(persistence_norm >= 0.3 AS BIGINT) AS flag_persistence, CAST(motif_enrichment >= 1 AS BIGINT) AS flag_motif FROM sr")
def community_score(spark, sf, types=_RELAYS):
    return plain(_scored(spark, sf, types=types).select("window_id", "global_cid", "suspicion_score", "persistence_norm", "motif_enrichment_norm", "is_suspicious", "flag_internal_flow", "flag_reciprocity", "flag_persistence", "flag_motif"), 4)


@query(f"WITH {EV}, {_FEATURES}, {_MOTIF_COUNT}, {_SCORE} SELECT window_id, CAST(global_cid AS BIGINT) AS global_cid, round(suspicion_score, 4) AS suspicion_score FROM sr WHERE suspicion_score >= 0.15 ORDER BY sr.suspicion_score DESC, window_id, sr.global_cid LIMIT 10")
def shortlist(spark, sf, types=_RELAYS):
    cfg = replace(_LOW, top_k_export=10)
    return plain(com.shortlist(_scored(spark, sf, cfg, types), cfg).select("window_id", "global_cid", "suspicion_score"), 4)


@query(f"WITH {EV}, {_FEATURES}, {_MOTIF_COUNT}, {_SCORE} SELECT count(*) AS n_communities, count(*) FILTER (suspicion_score >= 0.15) AS n_suspicious, round(avg(suspicion_score), 4) AS mean_score, round(coalesce(avg(alert_ratio) FILTER (suspicion_score >= 0.15), 0) / (SELECT avg(is_sar) FROM ev), 4) AS aer, count(*) FILTER (suspicion_score >= 0.15 AND alert_ratio < 0.3) AS n_unknown FROM sr")
def score_summary(spark, sf, types=_RELAYS):
    return plain(com.score_summary(_scored(spark, sf, types=types), _ev(spark, sf), _LOW), 4)


# An instance of any type counts for a community of a window if all its nodes are in it.
_ALL_COUNT = f"""{_all_motifs('wn', _KEYS)}, fn AS (SELECT window_id, motif_type, {_text('ed')} AS ed, unnest(nd) AS node FROM found),
mi AS (SELECT window_id, motif_type, ed, min(global_cid) AS lo, max(global_cid) AS hi FROM fn JOIN lb USING (window_id, node) GROUP BY 1, 2, 3),
mc AS (SELECT window_id, lo AS global_cid, count(*) AS n FROM mi WHERE lo = hi AND lo <> -1 GROUP BY 1, 2)"""


def _with_all_motifs(name: str) -> None:
    """The query `name`, which counts relays, once more with all five types."""
    f, sql = CATALOGUE[name]
    CATALOGUE[f"{name}_all"] = (lambda spark, sf: f(spark, sf, MOTIFS), sql.replace("WITH ", "WITH RECURSIVE ", 1).replace(_MOTIF_COUNT, _ALL_COUNT))


for _name in ("motif_enrichment", "community_score", "shortlist", "score_summary"):
    _with_all_motifs(_name)


@query(f"WITH {EV}, {_LABELS}, a AS (SELECT node, global_cid AS cid FROM lb WHERE window_id = 1 AND global_cid <> -1), b AS (SELECT node, node % 13 AS gcid FROM lb WHERE window_id = 0), m AS (SELECT cid, gcid, count(*) AS inter FROM a JOIN b USING (node) GROUP BY 1, 2) SELECT CAST(cid AS BIGINT) AS cid, CAST(gcid AS BIGINT) AS gcid, inter, round(inter / (na + nb - inter), 6) AS jaccard FROM m JOIN (SELECT cid, count(*) AS na FROM a GROUP BY 1) USING (cid) JOIN (SELECT gcid, count(*) AS nb FROM b GROUP BY 1) USING (gcid)")
def jaccard_overlap(spark, sf):
    _, labels = _stand_in(spark, sf)
    now = labels.where("window_id = 1 and global_cid <> -1").select("node", F.col("global_cid").alias("cid"))
    past = labels.where("window_id = 0").select("node", (F.col("node") % 13).alias("gcid"))
    return plain(tracking.jaccard_overlap(now, past))


@query(f"WITH {EV}, {_LABELS}, a AS (SELECT window_id, node, global_cid AS cid FROM lb WHERE global_cid <> -1), b AS (SELECT window_id + 1 AS window_id, node, node % 13 AS gcid FROM lb), m AS (SELECT window_id, cid, gcid, count(*) AS inter FROM a JOIN b USING (window_id, node) GROUP BY 1, 2, 3) SELECT window_id, CAST(cid AS BIGINT) AS cid, CAST(gcid AS BIGINT) AS gcid, inter, round(inter / (na + nb - inter), 6) AS jaccard FROM m JOIN (SELECT window_id, cid, count(*) AS na FROM a GROUP BY 1, 2) USING (window_id, cid) JOIN (SELECT window_id, gcid, count(*) AS nb FROM b GROUP BY 1, 2) USING (window_id, gcid)")
def jaccard_overlap_all(spark, sf):
    """Every window with the one before."""
    _, labels = _stand_in(spark, sf)
    now = labels.where("global_cid <> -1").select("window_id", "node", F.col("global_cid").alias("cid"))
    past = labels.select((F.col("window_id") + 1).alias("window_id"), "node", (F.col("node") % 13).alias("gcid"))
    return plain(tracking.jaccard_overlap(now, past, _KEYS))


@query(f"WITH {EV}, {_LABELS} SELECT CAST(global_cid AS BIGINT) AS global_cid, count(DISTINCT window_id) AS n_windows FROM lb WHERE global_cid <> -1 GROUP BY 1")
def persistence(spark, sf):
    return plain(tracking.persistence(_stand_in(spark, sf)[1]))


@query(f"WITH {EV}, {_LABELS}, s AS (SELECT DISTINCT window_id, global_cid FROM lb WHERE global_cid <> -1) SELECT window_id, CAST(global_cid AS BIGINT) AS global_cid, count(*) OVER (PARTITION BY global_cid ORDER BY window_id) AS n_windows FROM s")
def persistence_as_of(spark, sf):
    return plain(tracking.persistence(_stand_in(spark, sf)[1], as_of=True))


# Labels by node number keep their communities from window to window; ids then follow the first window's order.
@query(f"""WITH {EV}, {_LABELS}, ids AS (SELECT global_cid, row_number() OVER (ORDER BY global_cid) - 1 AS gid FROM (SELECT DISTINCT global_cid FROM lb WHERE global_cid <> -1)),
n AS (SELECT window_id, global_cid, count(*) AS size FROM lb GROUP BY 1, 2), ov AS (SELECT b.window_id, b.global_cid, count(*) AS inter FROM lb a JOIN lb b ON a.node = b.node AND a.global_cid = b.global_cid AND b.window_id = a.window_id + 1 GROUP BY 1, 2)
SELECT lb.window_id, lb.node, CAST(CASE WHEN lb.global_cid = -1 THEN -1 ELSE gid END AS BIGINT) AS global_cid, CAST(CASE WHEN lb.global_cid = -1 THEN 0 ELSE n.size END AS BIGINT) AS community_size,
  CASE WHEN lb.global_cid = -1 OR lb.window_id = 0 THEN 0 ELSE round(inter / (n.size + p.size - inter), 4) END AS overlap_score
FROM lb LEFT JOIN ids USING (global_cid) JOIN n ON n.window_id = lb.window_id AND n.global_cid = lb.global_cid LEFT JOIN n p ON p.window_id = lb.window_id - 1 AND p.global_cid = lb.global_cid LEFT JOIN ov ON ov.window_id = lb.window_id AND ov.global_cid = lb.global_cid""")
def tracking_record(spark, sf):
    labels = _stand_in(spark, sf)[1].withColumnRenamed("global_cid", "community_id")
    return plain(tracking.track(labels), 4)


def _window_matrix(spark, sf) -> DataFrame:
    w = windows.number_windows(windows.assign_windows(_ev(spark, sf), 10, 10))
    return edges.adjacency(edges.snapshot_edges(w, _KEYS), _KEYS)


@query()
def detect_leiden(spark, sf):
    return plain(detection.detect_communities(_window_matrix(spark, sf)))


@query()
def split_large(spark, sf):
    return plain(detection.split_large_communities(_window_matrix(spark, sf), CommunityConfig(s_max=20)))


@query()
def detect_infomap(spark, sf):
    return plain(detection.detect_communities(_window_matrix(spark, sf), CommunityConfig(method="infomap")))


# What labels of any method must hold: every active node once, no community under the least size or in several parts.
# Those of the methods that look for modularity must be better by 0.05 than labels by node number and than one community.
_METHODS = ("leiden", "infomap", "multilevel", "greedy", "trivial")


@query(f"""WITH {EV}, {_windows_sql(10, 10)}, mx AS (SELECT window_id, src_node AS i, dst_node AS j, sum(amount) AS w FROM wn GROUP BY 1, 2, 3), t AS (SELECT window_id, sum(w) AS m, coalesce(sum(w) FILTER (i % 20 = j % 20), 0) AS inside FROM mx GROUP BY 1),
co AS (SELECT window_id, i % 20 AS c, sum(w) AS o FROM mx GROUP BY 1, 2), ci AS (SELECT window_id, j % 20 AS c, sum(w) AS n FROM mx GROUP BY 1, 2), cx AS (SELECT window_id, sum(o * n) AS x FROM co JOIN ci USING (window_id, c) GROUP BY 1),
a AS (SELECT window_id, count(DISTINCT node) AS n FROM (SELECT window_id, i AS node FROM mx UNION ALL SELECT window_id, j FROM mx) GROUP BY 1)
SELECT method, window_id, a.n AS nodes, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS small, CAST(0 AS BIGINT) AS broken, round(inside / m - x / (m * m), 6) AS q_by_number, CASE method WHEN 'infomap' THEN NULL WHEN 'trivial' THEN 0 ELSE 1 END AS better
FROM t JOIN cx USING (window_id) JOIN a USING (window_id), (SELECT unnest({list(_METHODS)}) AS method)""")
def detect_invariants(spark, sf):
    matrix = settled(_window_matrix(spark, sf), "window_id", "i")
    by_number = edges.active_nodes(matrix, _KEYS).withColumn("community_id", F.col("node") % 20)
    plain_q = settled(detection.modularity(matrix, by_number, _KEYS).withColumnRenamed("q", "q_by_number"))

    def rows_of(method: str) -> DataFrame:
        cfg = CommunityConfig(method=method)
        labels = settled(detection.detect_communities(matrix, cfg, _KEYS))
        sizes = labels.where("community_id <> -1").groupBy("window_id", "community_id").agg(F.count("*").alias("n"))
        small = sizes.groupBy("window_id").agg(F.count(F.when(F.col("n") < cfg.min_comm_size, 1)).alias("small"))
        broken = detection.connected_parts(matrix, labels, _KEYS).groupBy("window_id").agg(F.count(F.when(F.col("parts") > 1, 1)).alias("broken"))
        nodes = labels.groupBy("window_id").agg(F.countDistinct("node").alias("nodes"), (F.count("*") - F.countDistinct("node")).alias("repeated"))
        rows = nodes.join(small, "window_id", "left").join(broken, "window_id", "left").join(plain_q, "window_id").join(detection.modularity(matrix, labels, _KEYS), "window_id")
        better = F.when(F.lit(method != "infomap"), (F.col("q") > F.greatest(F.col("q_by_number"), F.lit(0.0)) + 0.05).cast("bigint"))
        return rows.select(F.lit(method).alias("method"), "window_id", "nodes", "repeated", F.coalesce("small", F.lit(0)).alias("small"), F.coalesce("broken", F.lit(0)).alias("broken"), "q_by_number", better.alias("better"))

    # rounds of one method wait for each other, those of several don't
    return plain(reduce(DataFrame.unionByName, side_by_side(rows_of, _METHODS)))


@query()
def full_pipeline(spark, sf):
    ev = _ev(spark, sf)
    out = pipelines.community_pipeline(ev, window_size=14, window_stride=7, found=motifs.run_all(ev))
    return plain(out.features)


@query(
    f"""WITH RECURSIVE {EV}, o AS (SELECT min(step) AS o, max(step) AS m FROM ev), k AS (SELECT o + k * 7 AS chunk_start FROM o, (SELECT unnest(range(0, 1000)) AS k) WHERE o + k * 7 <= m),
ck AS (SELECT ev.*, chunk_start FROM ev JOIN k ON step BETWEEN chunk_start - 3 AND chunk_start + 6), {_all_motifs('ck', ('chunk_start',))}, f AS (SELECT * FROM found WHERE list_min(st) >= chunk_start) """
    + _motif_sql("f", "", "nd", "chunk_start,", quotient=True).replace("'' AS motif_type", "motif_type")
)
def motif_chunked(spark, sf):
    return plain_motifs(motifs.chunked(_ev(spark, sf)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
