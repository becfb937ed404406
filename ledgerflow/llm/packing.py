"""Best-fit packing of token pieces into sequences of a fixed length.

The driver sees only the histogram of piece lengths (at most `capacity` numbers).  On it stands a configuration linear
program: as few sequences as possible, each a multiset of lengths that fits.  Multiplicative weights price the lengths,
an unbounded knapsack by dynamic programming finds the best configurations at those prices, and gives a lower bound of
the program besides.  First only sequences without a gap are used, in a few rounds that give each length its share: where
there are many lengths that meets the bound.  Where it doesn't come within a thousandth of it, the whole program is
solved: lengths and configurations both carry weights, in optimistic steps, until value and bound are that close; its
solution is moved to a corner, which has at most one configuration a length, and rounded down.  What rounding leaves is
placed longest piece first, each sequence filled by the same dynamic program.  Pieces then find their place
by their rank among pieces of their length; ranks come from salted groups of bounded size, so a length that a third of
all pieces share lands in many tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytekernels import lean, slices, text_buffer
from .store import written
from .tokens import encoder


Configuration = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class PackRules:
    """rounds, rate: price updates of one solution by sequences without a gap (more follow, four times as many at most,
    while they cover a tenth of what is left), and how fast a covered length gets cheaper; near: configurations whose
    worth at the first prices is this close to the best are taken; phases: solutions at most; rest_percent: share of
    tokens that may be left to the end; undo_percent: the most of them that may be opened again to come closer to the
    bound than a thousandth.  gap: how close value and bound of the whole program must come; gap_rounds, steps: knapsacks
    at most, and steps of the weights after each; step: size of a
    step, halved when the weights don't settle."""

    capacity: int = 2048
    rounds: int = 4
    rate: float = 0.2
    near: float = 1e-6
    phases: int = 12
    rest_percent: int = 2
    undo_percent: int = 10
    gap: float = 1e-4
    gap_rounds: int = 80
    steps: int = 2000
    step: float = 0.3


@dataclass(frozen=True)
class Packing:
    """plan: configurations ((length, how many), ...) and their numbers of sequences, covering all pieces exactly.

    fractional: value of the program's fractional solution; bound: no packing has fewer sequences; rest_tokens: tokens of
    pieces that came neither from a solution nor its rounding; dual: the program's bound before it is rounded up.
    """

    plan: list[tuple[Configuration, int]]
    fractional: float
    bound: int
    rest_tokens: int
    dual: float

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.plan)


def _fill_table(lengths: np.ndarray, value: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(best value, length taken last) of filling every room up to `room` exactly, -inf and 0 if that can't be; lengths
    ascending, each as often as one likes."""
    best, last = np.full(room + 1, -np.inf), np.zeros(room + 1, np.int64)
    best[0] = 0.0
    fits = np.searchsorted(lengths, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        if k := fits[c]:
            got = value[:k] + best[c - lengths[:k]]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], last[c] = got[i], lengths[i]
    return best, last


def _unfold(last: np.ndarray, room: int) -> dict[int, int]:
    """The lengths of the best filling of `room`; a room that can't be filled is left a little emptier."""
    out: dict[int, int] = {}
    while room > 0:
        if n := int(last[room]):
            out[n] = out.get(n, 0) + 1
            room -= n
        else:
            room -= 1
    return out


def _priced(lengths: np.ndarray, price: np.ndarray, best: np.ndarray, room: int, have: np.ndarray) -> dict[int, int]:
    """A filling of `room` by the table's prices from pieces that are there (have, by place in lengths)."""
    out: dict[int, int] = {}
    while room > 0:
        k = int(np.searchsorted(lengths, room, "right"))
        got = np.where(have[:k] >= 1, price[:k] + best[room - lengths[:k]], -np.inf)
        i = int(got.argmax()) if k else -1
        if i < 0 or got[i] == -np.inf:
            room -= 1
            continue
        out[i] = out.get(i, 0) + 1
        have[i] -= 1
        room -= int(lengths[i])
    for i, a in out.items():
        have[i] += a
    return {int(lengths[i]): a for i, a in out.items()}


def _first_prices(counts: np.ndarray, c: int) -> tuple[np.ndarray, float]:
    """(prices of lengths at which the best filling is worth 1, lower bound they give): the best of a few mixtures of the
    length itself and of being over half a sequence, no two of which share one."""
    size = np.arange(c + 1)
    lengths = np.flatnonzero(counts)
    steps = (2 * size > c).astype(float)
    found = []
    for mix in (0.0, 0.25, 0.5, 0.75, 1.0):
        price = (1 - mix) * size / c + mix * steps
        price /= max(_fill_table(lengths, price[lengths], c)[0].max(), 1e-300)
        found.append((float((counts * price).sum()), mix, price))
    bound, _, price = max(found, key=lambda x: (x[0], -x[1]))
    return price, bound


def solve_full(counts: np.ndarray, rules: PackRules) -> tuple[dict[Configuration, float], float, float]:
    """(configurations without a gap with fractional numbers of sequences, value of that solution, lower bound).

    Multiplicative weights: a length costs less the more of it is covered.  In each round every length gets the best
    configuration at the prices that the pieces left allow, for its share, if the first prices, those of the best bound,
    make it a good one.  The knapsack's best value at any prices gives
    the dual bound.  No configuration takes more of a length than there is; what stays uncovered counts in the
    value as sequences of one length each.
    """
    c = rules.capacity
    left, covered = counts.astype(float), np.zeros(c + 1)
    lengths = np.flatnonzero(counts)
    shares: dict[Configuration, float] = {}
    size, before = np.arange(c + 1), np.inf
    first, bound = _first_prices(counts, c)
    near, rounds, rate = rules.near, rules.rounds, rules.rate
    for r in range(4 * rounds):
        live, now = lengths[left[lengths] > 1e-9], float((left * size).sum())
        if not len(live) or (r >= rounds and now > 0.9 * before):
            break
        before = now
        price = (first[live] + 0.02 * live / c) * (1 + 0.05 * live / c) * np.exp(-rate * covered[live] / counts[live])
        best, _ = _fill_table(live, price, c)
        bound = max(bound, float((counts[live] * price).sum() / best.max()))
        share = 1.0 / max(1, rounds - r)
        have = left[live]
        for i in range(len(live) - 1, -1, -1):
            n = int(live[i])
            if have[i] < 1:
                continue
            have[i] -= 1
            config = _priced(live, price, best, c - n, have)
            have[i] += 1
            config[n] = config.get(n, 0) + 1
            if sum(first[m] * a for m, a in config.items()) < 1 - near:
                continue  # a sequence that the bound doesn't allow
            times = min(left[m] / a for m, a in config.items())
            times = min(times, max(share * left[n] / config[n], min(1.0, times)))
            if times > 1e-9:
                key = tuple(sorted(config.items(), reverse=True))
                shares[key] = shares.get(key, 0.0) + times
                for m, a in config.items():
                    left[m] = max(0.0, left[m] - a * times)
                    have[np.searchsorted(live, m)] = left[m]
                    covered[m] += a * times
    value = sum(shares.values()) + float((left[lengths] / (c // lengths)).sum())
    return shares, value, bound


def _knapsack(lengths: np.ndarray, price: np.ndarray, room: int) -> np.ndarray:
    """Best value of filling every room up to `room` as far as is worth it; lengths as often as one likes."""
    best = np.zeros(room + 1)
    for n, v in zip(lengths.tolist(), price.tolist(), strict=True):
        for a in range(n, room + 1, n):
            b = min(a + n, room + 1)
            np.maximum(best[a:b], best[a - n : b - n] + v, out=best[a:b])
    return best


def _best_with(i: int, lengths: np.ndarray, price: np.ndarray, best: np.ndarray, c: int) -> tuple[tuple[int, int], ...]:
    """The best filling of c that has lengths[i], as ((place in lengths, how many), ...)."""
    out, room = {i: 1}, c - int(lengths[i])
    while k := int(np.searchsorted(lengths, room, "right")):
        got = price[:k] + best[room - lengths[:k]]
        j = int(got.argmax())
        if got[j] <= 1e-12:
            break
        out[j] = out.get(j, 0) + 1
        room -= int(lengths[j])
    return tuple(sorted(out.items()))


class _Columns:
    """Configurations as the columns of a sparse matrix: how many pieces of each length, over `scale` of the length."""

    def __init__(self, keys: list[tuple[tuple[int, int], ...]], scale: np.ndarray) -> None:
        self.starts = np.cumsum([0, *(len(k) for k in keys)])[:-1]
        self.rows = np.array([i for k in keys for i, _ in k], np.int64)
        self.cols = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        self.many = np.array([a for k in keys for _, a in k], float)
        self.entries, self.size = self.many / scale[self.rows], len(scale)

    def worth(self, y: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.entries * y[self.rows], self.starts)

    def cover(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.entries * x[self.cols], self.size)


def _stepped(weight: np.ndarray, move: np.ndarray) -> np.ndarray:
    out = np.maximum(weight * np.exp(np.clip(move, -1, 1)), 1e-30)
    return out / out.sum()


def solve_program(counts: np.ndarray, rules: PackRules) -> tuple[dict[Configuration, float], float, float]:
    """(configurations with numbers of sequences, value, lower bound) of the whole program, at a corner of it.

    A game: one side mixes lengths by weights, the other configurations; a step multiplies each weight by the exponential
    of its gain, the newest gain counted twice and the one before taken back.  The knapsack adds, at the prices met, the
    best configuration that has each length, and bounds the program; it ends when value and bound are `gap` apart.
    Lengths with the fewest pieces are left out, up to gap / 4 of all tokens.
    """
    c, size = rules.capacity, np.arange(rules.capacity + 1)
    lengths = np.flatnonzero(counts)
    rare = lengths[np.argsort(counts[lengths], kind="stable")]
    few = np.cumsum(counts[rare] * rare) <= rules.gap / 4 * (counts * size).sum()
    lengths = np.setdiff1d(lengths, rare[few])
    n, alone = counts[lengths].astype(float), c // lengths
    keys = {((i, int(a)),): None for i, a in enumerate(alone)}
    first, bound = _first_prices(np.where(np.isin(size, lengths), counts, 0), c)
    price, value, step = first[lengths], np.inf, rules.step
    chosen = np.zeros(0)
    x, y, before = np.zeros(0), price * n / (price @ n), np.inf
    for _ in range(rules.gap_rounds):
        best = _knapsack(lengths, price, c)
        bound, had = max(bound, float(n @ price / best[c])), len(keys)
        for i in range(len(lengths)):
            key = _best_with(i, lengths, price, best, c)
            if sum(price[j] * a for j, a in key) > 0.9 * best[c]:
                keys.setdefault(key)
        program = _Columns(list(keys), n / bound)
        x = np.concatenate([x, np.zeros(len(keys) - len(x))]) + 1e-3 / len(keys)
        x /= x.sum()
        worth, cover = program.worth(y), program.cover(x)
        old = worth, cover
        xs, ys = np.zeros(len(x)), np.zeros(len(y))
        for t in range(1, rules.steps + 1):
            x, y = _stepped(x, step * (2 * worth - old[0] - 1)), _stepped(y, step * (1 + old[1] - 2 * cover))
            old = worth, cover
            worth, cover = program.worth(y), program.cover(x)
            xs += x
            ys += y
            if t % 200 == 0 and program.worth(ys / t).max() - program.cover(xs / t).min() < rules.gap / 4:
                break
        apart = float(program.worth(ys / t).max() - program.cover(xs / t).min())
        if len(keys) == had and apart > 0.5 * before:
            step /= 2  # these steps are too long to settle
        before = apart
        for mix in (x, xs / t):
            got = program.cover(mix) * n / bound
            for times in np.quantile(n / np.maximum(got, 1e-12), (0, 0.25, 0.5, 0.75, 0.9, 1)):
                v = times + float((np.maximum(0, n - times * got) / alone).sum())
                if v < value:
                    value, chosen = v, mix * times
        prices = [y / n, ys / n]
        tops = [float(n @ p / _knapsack(lengths, p, c)[c]) for p in prices]
        price, bound = prices[int(np.argmax(tops))], max(bound, *tops)
        if value <= (1 + rules.gap) * bound:
            break
    chosen = np.concatenate([chosen, np.zeros(len(keys) - len(chosen))])
    chosen[chosen < 1e-6] = 0
    matrix = _Columns(list(keys), np.ones(len(n)))
    chosen[: len(n)] += np.maximum(0, n - matrix.cover(chosen)) / alone  # the first ones have one length each
    corner = _corner(list(keys), chosen, n)
    shares = {tuple((int(lengths[i]), a) for i, a in reversed(k)): v for k, v in zip(keys, corner, strict=True) if v > 1e-9}
    return shares, sum(shares.values()), bound


def _corner(keys: list[tuple[tuple[int, int], ...]], chosen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A solution no dearer than `chosen` (which covers n) with at most one configuration a length.

    The surplus of each length is the first basis.  Every configuration in turn grows while that isn't dearer, or else
    shrinks; it ends at nothing, or takes the place of whatever reaches nothing first.
    """
    m, chosen = len(n), chosen.copy()
    inverse = -np.eye(m)
    basis = np.full(m, -1)  # -1: a surplus
    held = np.maximum(0, _Columns(keys, np.ones(m)).cover(chosen) - n)
    for j in np.flatnonzero(chosen > 0):
        column = np.zeros(m)
        for i, a in keys[j]:
            column[i] = a
        d = inverse @ column  # the basis loses d for each one more of j
        up = 1 - d[basis >= 0].sum() <= 0
        push = d if up else -d
        falls = push > 1e-9
        ratio = np.where(falls, held / np.where(falls, push, 1), np.inf)
        out = int(ratio.argmin())
        move = float(ratio[out])
        if not up and move >= chosen[j]:
            held = np.maximum(0, held + d * chosen[j])
            chosen[j] = 0
            continue
        if move == np.inf:
            continue
        held = np.maximum(0, held - push * move)
        now = chosen[j] + (move if up else -move)
        if basis[out] >= 0:
            chosen[basis[out]] = 0
        basis[out], held[out] = j, now
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
    done = np.zeros(len(chosen))
    done[basis[basis >= 0]] = held[basis >= 0]
    return done


def _rounded(shares: dict[Configuration, float], rest: np.ndarray) -> list[tuple[Configuration, int]]:
    """Whole sequences of a solution, the most frequent configurations first, as far as pieces last (rest is reduced)."""
    plan = []
    for key, times in sorted(shares.items(), key=lambda x: (-x[1], x[0])):
        if whole := min(max(1, round(times)), *(int(rest[m]) // a for m, a in key)):
            plan.append((key, whole))
            for m, a in key:
                rest[m] -= a * whole
    return plan


def solve_configurations(counts: np.ndarray, rules: PackRules = PackRules()) -> list[tuple[Configuration, int]]:
    """[(configuration, number of sequences)], covering counts[length] pieces exactly."""
    return solve_packing(counts, rules).plan


def solve_packing(counts: np.ndarray, rules: PackRules = PackRules()) -> Packing:
    """solve_configurations() with the figures of its program."""
    found = _full_packing(counts, rules)
    if found.sequences > 1.001 * found.bound + 1:
        found = min(_corner_packing(counts, rules, found.dual), found, key=lambda x: x.sequences)
    return found


def _corner_packing(counts: np.ndarray, rules: PackRules, dual: float) -> Packing:
    """The corner of the whole program rounded down; what is left is placed longest first, or the corner's fractions are
    rounded up as far as pieces last if that takes fewer sequences."""
    counts = counts.astype(np.int64)
    shares, value, bound = solve_program(counts, rules)
    dual = max(dual, bound)
    rest, plan = counts.copy(), []
    for key, times in sorted(shares.items()):
        whole = int(times + 1e-6)
        while whole and (fits := tuple((m, min(a, int(rest[m]))) for m, a in key if rest[m])):  # the corner may have more of a length than there is
            some = min(whole, *(int(rest[m]) // a for m, a in fits))
            plan.append((fits, some))
            for m, a in fits:
                rest[m] -= a * some
            whole -= some
    first = _ended(plan, rest.copy(), counts, value, dual, rules)
    second = []
    for key, _ in sorted(shares.items(), key=lambda x: (int(x[1]) - x[1], x[0])):
        if fits := tuple((m, min(a, int(rest[m]))) for m, a in key if rest[m]):
            second.append((fits, 1))
            for m, a in fits:
                rest[m] -= a
    second += _place_rest(rest.copy(), rules.capacity)
    return min(first, Packing(plan + second, value, first.bound, int((rest * np.arange(rules.capacity + 1)).sum()), dual), key=lambda x: x.sequences)


def _full_packing(counts: np.ndarray, rules: PackRules) -> Packing:
    c = rules.capacity
    counts = counts.astype(np.int64)
    rest, plan, size = counts.copy(), [], np.arange(c + 1)
    total, value, bound = int((counts * size).sum()), 0.0, 0.0
    for phase in range(rules.phases):
        before = int((rest * size).sum())
        if before * 100 <= total * rules.rest_percent:
            break
        shares, v, b = solve_full(rest, rules)
        if phase == 0:
            value, bound = v, b
        plan += _rounded(shares, rest)
        if int((rest * size).sum()) > 0.9 * before:
            break
    return _ended(plan, rest, counts, value, bound, rules)


def _ended(plan: list[tuple[Configuration, int]], rest: np.ndarray, counts: np.ndarray, value: float, bound: float, rules: PackRules) -> Packing:
    """plan with the rest placed; while that is over the bound, sequences of the smallest pieces are opened and placed
    anew, up to undo_percent of all tokens."""
    c, size, plan = rules.capacity, np.arange(rules.capacity + 1), list(plan)
    total = int((counts * size).sum())
    least = max(int(np.ceil(bound - 1e-6)), int(counts[c // 2 + 1 :].sum()))
    best: Packing | None = None
    while True:
        left = int((rest * size).sum())
        found = Packing(plan + _place_rest(rest.copy(), c), value, least, left, bound)
        if best is None or found.sequences < best.sequences:
            best = found
        if best.sequences <= least or not plan or left * 100 > total * rules.undo_percent / 2:
            return best
        plan = sorted(plan, key=lambda x: (sum(a for _, a in x[0]), x))
        while plan and int((rest * size).sum()) < 2 * left + c:
            key, times = plan.pop()
            opened = min(times, max(1, (2 * left - int((rest * size).sum())) // c))
            for m, a in key:
                rest[m] += a * opened
            if times > opened:
                plan.append((key, times - opened))


def _place_rest(rest: np.ndarray, c: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations for what rounding left: the longest piece first, its room filled best."""
    out: dict[tuple[tuple[int, int], ...], int] = {}
    table_for, last = -1, np.zeros(1, np.int64)
    while len(live := np.flatnonzero(rest)):
        top = int(live[-1])
        chosen: dict[int, int] = {top: 1}
        room, have = c - top, rest.copy()
        have[top] -= 1
        while room > 0:
            if table_for < room:
                some = np.flatnonzero(have[: room + 1])
                _, last = _fill_table(some, some * (1 + 1e-4 * some / c), room)
                table_for = room
            fill = _unfold(last, room)
            if all(have[m] >= a for m, a in fill.items()):
                break
            if any(not have[m] for m in fill):
                table_for = -1  # a length ran out: the table is made anew
                continue
            part = max((m for m in fill), key=lambda m: m)  # too few of one: take what there is, fill the room again
            have[part] -= 1
            chosen[part] = chosen.get(part, 0) + 1
            room -= part
        else:
            fill = {}
        for m, a in fill.items():
            chosen[m] = chosen.get(m, 0) + a
        times = max(1, min(int(rest[m]) // a for m, a in chosen.items()))
        for m, a in chosen.items():
            rest[m] -= a * times
        key = tuple(sorted(chosen.items(), reverse=True))
        out[key] = out.get(key, 0) + times
    return list(out.items())


def cut_pieces(df: DataFrame, tokenizer_path: str, end_id: int, rules: PackRules = PackRules(), id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): documents with the end id, those over the capacity cut so
    that only the first piece may be shorter.  A null text is empty: one piece with the end id.  A row without an id keeps
    a null doc_id; repeated rows make pieces of their own, other columns are left out, and texts of any length are encoded
    whole.  Strings of special tokens in a text are those tokens, as the tokenizers library has it by default."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    c = rules.capacity

    def cut(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, places in slices(data, offsets):
                ids, ends = encoder(tokenizer_path).encode_with_end(part, places, end_id)
                size = np.diff(ends)
                n = -(-size // c)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                short = size - (n - 1) * c  # of the first piece
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * c)
                length = np.where(piece == 0, short[row], c)
                at = ends[:-1][row] + start
                view = memoryview(ids.astype("<u4", copy=False).tobytes())
                crc = [zlib.crc32(view[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
                cols = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.array([ids[x : x + y].tolist() for x, y in zip(at, length, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(lean(cut), schema)


def _places(plan) -> tuple[np.ndarray, ...]:
    """For runs of ranks of a length, ascending: length << 40 | first rank, pieces a sequence, first sequence, offset."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for key, times in plan:
        at = 0
        for m, a in key:
            rows.append(((m << 40) | rank.get(m, 0), a, sequence, at))
            rank[m] = rank.get(m, 0) + a * times
            at += m * a
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(pieces: DataFrame, rules: PackRules = PackRules()) -> DataFrame:
    """pieces with sequence_id and offset: every piece once, sequences without gaps from 0, none over the capacity.

    `pieces` (doc_id, piece, length, ids_crc32 and any others) is read several times: pass a written table.  Equal rows are
    different pieces, ties of a length are dealt by doc_id, piece and ids_crc32, and an empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = np.zeros(rules.capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    plan = solve_configurations(counts, rules)
    total, tasks = int(counts.sum()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = np.maximum(1, -(-counts * 8 * tasks // max(1, total)))  # groups of about total / (8 tasks) rows: capacity + 8 tasks groups in all
    table = F.split(F.lit(",".join(map(str, salts))), ",").cast("array<int>")
    # the salt is a function of the row, so that a task that is run again deals the same
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(table, F.col("length").cast("int"))).cast("int"))
    groups = {(r["length"], r["__salt"]): r["count"] for r in salted.groupBy("length", "__salt").count().collect()}
    first, before = {}, {}
    for n, s in sorted(groups):
        first[n, s] = before.get(n, 0)
        before[n] = first[n, s] + groups[n, s]
    key = np.array([(n << 20) | s for n, s in first], np.int64)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], np.array(list(first.values()), np.int64)[order], *_places(plan)))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    names = pieces.columns

    def place(batches):
        keys, offsets, start, many, sequence, at = shared.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            salt = batch.column(batch.schema.get_field_index("__salt")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy().astype(np.int64)
            rank = rank + offsets[np.searchsorted(keys, (length << 20) | salt)]
            run = np.searchsorted(start, (length << 40) | rank, "right") - 1
            inner = rank - (start[run] & ((1 << 40) - 1))
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            cols += [pa.array(sequence[run] + inner // many[run]), pa.array(at[run] + inner % many[run] * length)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int, rules: PackRules = PackRules(), id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """cut_pieces(), written, then pack()."""
    return pack(written(cut_pieces(df, tokenizer_path, end_id, rules, id_col, text_col, keep_ids), "pieces"), rules)
