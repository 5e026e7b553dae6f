"""Best-fit packing of token sequences by a configuration linear program.

Only the length histogram (one row a length, ``capacity`` rows at most) comes to
the driver. The covering program over configurations is solved by
multiplicative weights, with an unbounded-knapsack table as pricing step, to a
gap from its dual bound; the fractional solution is rounded. The plan is
a short table of runs: pieces of one length, by rank, fill one slot of a run of
sequences. Pieces get ranks by salted windows and meet the plan in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise
from .tokens import encoder, tokenizer_path

#: Pieces of one length that one ranking window holds at least; with more than its square, the root of their number.
RANK_BLOCK = 256
#: Times that what whole parts leave is solved again; times that the rest is priced anew before the tail goes best fit.
RESOLVES, RETRIES = 4, 400
#: Rounds of covers without gain after which the pool's program is solved instead.
PATIENCE = 8


def split_pieces(df: DataFrame, capacity: int = 1024, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every whole text: id, piece, start, length, ids_crc32.

    Only documents longer than ``capacity`` are cut; their first piece is the
    shorter one. A null or empty text is the end id alone.
    """
    path = path or tokenizer_path()
    bounded_batches(df.sparkSession)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, ids in zip(frame["id"], encoder(path).batch(frame["text"].tolist()), strict=True):
                n = len(ids) // 4
                first = n if n <= capacity else (n % capacity or capacity)
                start = 0
                for k, end in enumerate(range(first, n + 1, capacity)):
                    rows.append((doc, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start = end
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"]).astype({"id": frame["id"].dtype})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def _price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value at each room, and the length chosen there (0: leave it).

    A length that shorter ones fill at a greater value is in no best choice and is passed over.
    """
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths, worth, used = np.zeros(capacity, dtype=np.int64), np.zeros(capacity), 0
    listed = values.tolist()
    for room in range(1, capacity + 1):
        top, at = best[room - 1], 0
        if used:
            each = worth[:used] + best[room - lengths[:used]]
            k = int(each.argmax())
            if each[k] > top:
                top, at = each[k], lengths[k]
        if (own := listed[room]) > 0 and own >= top - 1e-12:
            lengths[used], worth[used], used = room, own, used + 1
            if own > top:
                top, at = own, room
        best[room], choice[room] = top, at
    return best, choice


def _unfold(room: int, choice: np.ndarray) -> Counter:
    out: Counter = Counter()
    while room > 0:
        if length := int(choice[room]):
            out[length] += 1
            room -= length
        else:
            room -= 1
    return out


class Program(NamedTuple):
    """A covering by configurations: sequences used, a bound that no covering beats, the amounts, the prices of lengths, and the whole amounts of the covering that the pool starts from."""

    value: float
    bound: float
    amounts: dict[tuple[int, ...], float]
    prices: np.ndarray
    start: dict[tuple[int, ...], float]


def _cover(counts: np.ndarray, prices: np.ndarray, capacity: int, slack: float = 0.01) -> tuple[float, dict[tuple[int, ...], float], np.ndarray, float]:
    """Cover ``counts`` by the dearest configurations, priced anew as lengths run out.

    Returns the cost, the amounts, what each length paid (a configuration
    shares its cost among its pieces by their prices) and the dearest value of
    all.
    """
    left, paid, used, cost, dearest = counts.astype(float), np.zeros(capacity + 1), {}, 0.0, 0.0
    while (present := np.flatnonzero(left > 1e-9)).size:
        values = np.zeros(capacity + 1)
        values[present] = prices[present]
        best, choice = _price(values, capacity)
        dearest = dearest or float(best[capacity])
        worth = prices[present] + best[capacity - present]
        for length in present[worth >= worth.max() * (1 - slack)][::-1].tolist():
            if left[length] <= 1e-9:
                continue
            pattern = _unfold(capacity - length, choice)
            pattern[length] += 1
            lengths = np.fromiter(pattern, dtype=np.int64)
            times = np.fromiter(pattern.values(), dtype=np.int64)
            amount = float((left[lengths] / times).min())
            if amount <= 1e-9:
                continue
            left[lengths] -= times * amount
            cost += amount
            paid[lengths] += amount * times * prices[lengths] / float(times @ prices[lengths])
            key = tuple(sorted(pattern.elements(), reverse=True))
            used[key] = used.get(key, 0.0) + amount
    return cost, used, paid, dearest


class _Pool:
    """Configurations met so far, as a sparse matrix: of each, its lengths and how often they occur."""

    def __init__(self) -> None:
        self.number: dict[tuple[tuple[int, int], ...], int] = {}

    def add(self, pattern: Counter) -> int:
        return self.number.setdefault(tuple(sorted(pattern.items())), len(self.number))

    def matrix(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column, row (by ``place`` of a length) and entry of the matrix's cells."""
        cells = [(k, length, n) for key, k in self.number.items() for length, n in key]
        column, length, n = (np.array(x) for x in zip(*cells, strict=True))
        return column, place[length], n.astype(float)


def _restricted(pool: _Pool, counts: np.ndarray, amounts: np.ndarray, shares: np.ndarray, steps: int = 1500, rate: float = 0.3) -> tuple[float, np.ndarray, np.ndarray]:
    """The covering program over the pool's configurations, by multiplicative weights on both sides.

    A game: configurations share a number of sequences, lengths share a unit of
    weight; a length's cover is multiplied into its weight, a configuration's
    worth into its share, each with the last change counted twice (the
    optimistic step, with which both settle and do not circle). Returns the best
    cost of a full covering, its amounts, and the lengths' weights.
    """
    present = np.flatnonzero(counts)
    place = np.zeros(len(counts), dtype=np.int64)
    place[present] = np.arange(len(present))
    column, row, times = pool.matrix(place)
    n, m, total = len(pool.number), len(present), float(amounts.sum())
    entry = times / counts[present][row] * total
    x, w = np.maximum(amounts / total, 1e-9 / n), np.maximum(shares / shares.sum(), 1e-12)
    log_x, log_w = np.log(x), np.log(w)
    cover, worth = (lambda x: np.bincount(row, entry * x[column], m)), (lambda w: np.bincount(column, entry * w[row], n))
    last_cover, last_worth, mean_x, mean_w = cover(x), worth(w), np.zeros(n), np.zeros(m)
    best, bound = (math.inf, x), (0.0, w)
    for step in range(1, steps + 1):
        now_cover, now_worth = cover(x), worth(w)
        log_x, log_w = log_x + rate * (2 * now_worth - last_worth), log_w - rate * (2 * now_cover - last_cover)
        last_cover, last_worth = now_cover, now_worth
        x, w = np.exp(log_x - log_x.max()), np.exp(log_w - log_w.max())
        x, w = x / x.sum(), w / w.sum()
        mean_x, mean_w = mean_x + x, mean_w + w
        if step % 250 == 0:
            for one in (x, mean_x / step):
                if (least := cover(one).min()) > 0 and total / least < best[0]:
                    best = total / least, one * total / least
            for one in (w, mean_w / step):
                bound = max(bound, (1 / worth(one).max(), one), key=lambda b: b[0])
    return best[0], best[1], bound[1]


def solve_configurations(counts: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 30, tries: int = 12) -> Program:
    """Fractional covering of ``counts`` (by length) with configurations, by multiplicative weights and knapsack pricing.

    The weights are prices of lengths. Each round covers all counts with the
    dearest configurations that a knapsack table finds, and multiplies a
    length's price by a falling power of what it paid over its price: lengths
    that only poor configurations take get dearer and go first. All
    configurations met, and those of a best-fit packing, form a pool. If covers
    alone leave a gap (few lengths), the program over the pool is solved by
    weights on both sides, and its prices, and mixtures of them with the best
    prices so far, price new configurations in, ``tries`` times at most. Prices
    over the dearest configuration's value are a dual solution. Ends when value
    and bound are within ``gap``, or need the same number of whole sequences, or
    when two tries in a row gain nothing.
    """
    present = np.flatnonzero(counts)
    volume = np.zeros(capacity + 1)
    volume[present] = present / capacity
    prices, best_prices, dual = volume.copy(), volume.copy(), volume.copy()
    value, bound, amounts, mean = math.inf, float(counts @ volume), {}, np.zeros(capacity + 1)
    pool, solutions = _Pool(), []

    def closed() -> bool:
        return value <= bound * (1 + gap) or math.ceil(value - 1e-6) <= math.ceil(bound - 1e-6)

    def keep(solution: dict[tuple[int, ...], float]) -> None:
        solutions.append({pool.add(Counter(key)): amount for key, amount in solution.items()})

    fit: dict[tuple[int, ...], float] = {}
    for pattern, times in _best_fit(counts, capacity):
        key = tuple(sorted(pattern.elements(), reverse=True))
        fit[key] = fit.get(key, 0.0) + times
    keep(fit)
    last = 0
    for done in range(rounds):
        cost, used, paid, dearest = _cover(counts, prices, capacity)
        keep(used)
        mean += prices / dearest
        for one in (prices / dearest, mean / _price(mean, capacity)[0][capacity]):
            if (least := float(counts @ one)) > bound:
                bound, dual = least, one
        if cost < value:
            value, amounts, best_prices, last = cost, used, prices.copy(), done
        if closed():
            return Program(value, bound, amounts, best_prices, fit)
        if done - last == PATIENCE:
            break
        prices[present] *= (paid[present] / (counts[present] * prices[present])) ** (1 / (1 + done / 8))
        # Floor: no price below a hundredth of its share of the volume.
        prices[present] = np.maximum(prices[present] / float(prices[present] @ counts[present]) * value, present / capacity / 100)
    start, shares = np.zeros(len(pool.number)), counts[present] * dual[present]
    for solution in solutions:
        start[list(solution)] += np.array(list(solution.values())) / len(solutions)
    idle = 0
    for _ in range(tries):
        cost, found, shares = _restricted(pool, counts, start, shares)
        prices = np.zeros(capacity + 1)
        prices[present] = shares / counts[present]
        prices /= _price(prices, capacity)[0][capacity]
        idle = 0 if cost < value * (1 - 1e-6) else idle + 1
        if cost < value:
            keys, least = list(pool.number), cost * 1e-9
            value, amounts = cost, {tuple(sorted(Counter(dict(keys[k])).elements(), reverse=True)): float(found[k]) for k in np.flatnonzero(found > least).tolist()}
            best_prices = prices.copy()
        before = len(pool.number)
        for part in (1.0, 0.5, 0.2):
            mixed = part * prices + (1 - part) * dual
            best, choice = _price(mixed, capacity)
            if (least := float(counts @ mixed) / best[capacity]) > bound:
                bound, dual = least, mixed / best[capacity]
            for length in present[mixed[present] + best[capacity - present] >= best[capacity] * 0.99].tolist():
                pattern = _unfold(capacity - length, choice)
                pattern[length] += 1
                pool.add(pattern)
        if closed() or idle > 1:
            break
        new = len(pool.number) - before
        start = np.concatenate([np.maximum(found, cost * 1e-6 / before), np.full(new, cost * 1e-3 / max(1, new))])
    return Program(value, bound, amounts, best_prices, fit)


class Plan(NamedTuple):
    """Runs (length, first rank, count, first sequence, offset), the sequences, and the program's value and bound.

    Pieces of ``length`` with ranks ``first rank + i`` lie at ``offset`` in
    sequence ``first sequence + i`` for ``i < count``.
    """

    runs: list[tuple[int, int, int, int, int]]
    sequences: int
    value: float
    bound: float


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """The longest piece, then always the longest that fits, as often as the counts allow."""
    left, out = left.copy(), []
    while left.any():
        gap, pattern, spare = capacity, Counter(), left.copy()
        while (fitting := np.flatnonzero(spare[: gap + 1])).size:
            length = int(fitting[-1])
            times = min(int(spare[length]), gap // length)
            pattern[length] += times
            spare[length] -= times
            gap -= length * times
        times = min(int(left[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            left[length] -= n * times
        out.append((pattern, times))
    return out


def _rounded(left: np.ndarray, program: Program, capacity: int) -> list[tuple[Counter, int]]:
    """Whole parts of the program's amounts; what they leave is a program of its own, RESOLVES times while whole parts come of it.

    The rest is priced on, one configuration at a time within the counts, and
    its tail, which no dear configuration takes, goes best fit.
    """
    left, out = left.copy(), []

    def take(pattern: Counter, times: int) -> None:
        for length, n in pattern.items():
            left[length] -= n * times
        out.append((pattern, times))

    for _ in range(RESOLVES):
        before = len(out)
        for key, amount in sorted(program.amounts.items(), key=lambda x: (-x[1], x[0])):
            pattern = Counter(key)
            if whole := min(int(amount + 1e-9), min(int(left[length]) // n for length, n in pattern.items())):
                take(pattern, whole)
        if not left.any():
            return out
        if len(out) == before:
            break
        program = solve_configurations(left, capacity, rounds=8, tries=2)
    for _ in range(RETRIES):
        present = np.flatnonzero(left)
        if not present.size:
            break
        values = np.zeros(capacity + 1)
        values[present] = program.prices[present]
        best, choice = _price(values, capacity)
        top, before = best[capacity] * 0.995, len(out)
        for length in present[::-1].tolist():
            while left[length]:
                pattern = _unfold(capacity - length, choice)
                pattern[length] += 1
                if any(left[k] < n for k, n in pattern.items()) or sum(program.prices[k] * n for k, n in pattern.items()) < top:
                    break
                take(pattern, min(int(left[k]) // n for k, n in pattern.items()))
        if len(out) == before:
            break
    return out + _best_fit(left, capacity)


def round_program(left: np.ndarray, program: Program, capacity: int) -> list[tuple[Counter, int]]:
    """The fewer sequences of two roundings, of the program's best covering and of the one that its pool starts from (whole amounts); of equals the former."""
    return min((_rounded(left, program._replace(amounts=a), capacity) for a in (program.amounts, program.start)), key=lambda x: sum(times for _, times in x))


def plan_runs(histogram: dict[int, int], capacity: int) -> Plan:
    """Solve the program, round it, and lay the configurations out."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    if not left.any():
        return Plan([], 0, 0.0, 0.0)
    program = solve_configurations(left, capacity)
    rank, runs, sequences = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for pattern, times in round_program(left, program, capacity):
        offset = 0
        for length in sorted(pattern.elements(), reverse=True):
            runs.append((length, int(rank[length]), times, sequences, offset))
            rank[length] += times
            offset += length
        sequences += times
    return Plan(runs, sequences, program.value, program.bound)


def pack_best_fit(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (see ``split_pieces``).

    ``pieces`` must be a written table, as it is read for the histogram and
    again for the placement. Full pieces need no rank and no shuffle: each is a
    sequence of its own, with a negative id. Lengths outside 1..capacity are an
    error. An empty table gives an empty result; repeated rows and null ids are
    pieces like others.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row a length
    if bad := [x for x in histogram if x is None or not 1 <= x <= capacity]:
        raise ValueError(f"piece lengths outside 1..{capacity}: {bad[:5]}")
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    histogram.pop(capacity, None)
    runs = plan_runs(histogram, capacity).runs
    if not runs:
        return full
    plan = spark.createDataFrame(runs, "length long, first_rank long, run long, first_sequence long, offset long")
    blocks = spark.createDataFrame([(k, -(-n // max(RANK_BLOCK, math.isqrt(n)))) for k, n in histogram.items()], "length long, blocks long")
    rest = pieces.filter(F.col("length") < capacity).join(F.broadcast(blocks), "length")  # a row a length
    rest = rest.withColumn("__block", F.pmod(F.xxhash64(id_col, "piece", "start", "ids_crc32"), F.col("blocks"))).drop("blocks")
    counts = rest.groupBy("length", "__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__block").orderBy(id_col, "piece", "ids_crc32"))
    ranked = rest.withColumn("__within", within).join(starts, ["length", "__block"]).withColumn("__rank", F.col("__before") + F.col("__within") - 1)
    by_length = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "run", "first_sequence", "offset"))).alias("__runs"))
    placed = ranked.join(F.broadcast(by_length), "length")  # one row a length; its runs come from histogram cells alone
    hit = F.filter("__runs", lambda r: (F.col("__rank") >= r["first_rank"]) & (F.col("__rank") < r["first_rank"] + r["run"]))[0]
    placed = placed.withColumn("__hit", hit).withColumn("sequence_id", F.col("__hit.first_sequence") + F.col("__rank") - F.col("__hit.first_rank")).withColumn("offset", F.col("__hit.offset"))
    return placed.select(*full.columns).unionByName(full)


def pack_documents(df: DataFrame, capacity: int = 1024, path: str | None = None) -> DataFrame:
    """Cut, write the small piece table, pack. See ``split_pieces`` and ``pack_best_fit``."""
    pieces = materialise(split_pieces(df, capacity, path), "pieces")
    return pack_best_fit(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
