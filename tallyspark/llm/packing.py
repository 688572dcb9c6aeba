"""Filling fixed-capacity containers: a configuration linear program over the length histogram.

Only the histogram of lengths reaches the driver; it has at most ``capacity`` entries however many documents there are.
There the linear program over container patterns (how often each group of lengths occurs in one container) is solved by
multiplicative weights: each round's prices are the groups' weights, the best pattern at these prices is found by a
knapsack dynamic program, it is used as far as the scarcest group allows, and the weight of every group that it holds
is multiplied down. Rounds come in epochs, each longer and with smaller steps than the one before and begun at its
weights; they end when an epoch's value is within ``GAP`` of the bound that the prices of a round give, not after a
number. Groups are of about equal volume and count by their mean on a grid, so a round costs the same at any capacity.

Patterns are rounded to whole containers by running sums, each place of a pattern gets the longest real length of its
group that still fits, and what is left over goes, longest first, into the room that real lengths leave there and then
into containers of its own. Of several shares of the program's containers the one with the fewest containers in all is taken.
A lower bound of any packing is certified from prices at full resolution (``certified_bound``), and is never below the
plain volume.

Documents are then matched to the patterns' slots by their rank within their length. Ranks come from two levels, a salt
of the id and the row within length and salt, so that a length that a third of all documents share is never one task.
A document larger than a container is cut into full containers of its own and a rest, which is packed like an item.

Defined results: a null text is an empty one (its end token is one token); a budget of null or non-positive capacity, a
null id, and repeated budget names beyond the first (least capacity) are left out; repeated ids are items of their own.
Of an empty table nothing is packed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.engine.shared import durable

#: Cells of the grid that lengths are rounded to for the linear program, groups of about equal volume that it has, and
#: the relative gap between its value and its prices' bound at which it is solved.
CELLS, GROUPS, GAP = 512, 24, 0.05
#: The first epoch: its rounds, and the exponent by which a weight falls when all of a group's items are covered once more;
#: and what either is multiplied by from epoch to epoch.
ROUNDS, RATE, MORE_ROUNDS, LESS_RATE = 200, 0.3, 1.5, 0.5
#: Share of the program's containers that are rounded, and how often what is left over is solved anew.
SHARE, PASSES = 0.95, 3
#: Lengths below so many cells are priced by volume when the bound is certified.
SAND_CELLS = 8
#: Largest capacity whose histogram is read on the driver.
MAX_CAPACITY = 1 << 20
#: Runs of plans that are sent to the workers at once (24 bytes each).
MOST_RUNS = 4_000_000
#: Salts of a length's documents for each shuffle partition.
SALTS_PER_PARTITION = 2


def byte_tokens(text: Column) -> Column:
    """The tokens of a text for a byte-level tokenizer: its UTF-8 bytes and one end token."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


TOKENIZERS = {"byt5": byte_tokens}


def _tables(sizes: np.ndarray, values: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """best[c], the greatest value of a multiset of size at most c, and the choices; copies are added in powers of two."""
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for k in range(len(sizes)):
        left, copies = int(min(counts[k], capacity // sizes[k])), 1
        while left > 0:
            c = min(copies, left)
            left, copies = left - c, copies * 2
            size = int(sizes[k]) * c
            if size > capacity:
                break
            other = best[: capacity + 1 - size] + values[k] * c
            better = other > best[size:]
            np.maximum(best[size:], other, out=best[size:])
            taken.append((k, c, better))
    return best, taken


def knapsack(lengths: np.ndarray, values: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset {index: copies} whose lengths fit the capacity: bounded knapsack by binary copies."""
    best, taken = _tables(lengths, values, counts, capacity)
    out: dict[int, int] = {}
    room = capacity
    for k, c, better in reversed(taken):
        size = int(lengths[k]) * c
        if room >= size and better[room - size]:
            out[k] = out.get(k, 0) + c
            room -= size
    return out


def grouped(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The group of each length (ascending): neighbours of about equal volume."""
    volume = np.cumsum(lengths * counts)
    group = np.minimum((volume - lengths * counts / 2) * GROUPS // volume[-1], GROUPS - 1).astype(np.int64)
    return np.unique(group, return_inverse=True)[1]


def _grid(capacity: int) -> int:
    """Tokens of a cell."""
    return -(-capacity // CELLS)


def certified_bound(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> float:
    """Containers that any packing needs: the priced total over a bound of what any container can hold at these prices.

    Lengths are rounded down to the grid; short ones are priced by volume, so that room between cells is never free.
    """
    cell = _grid(capacity)
    sand = lengths < SAND_CELLS * cell
    rate = float((prices[sand] / lengths[sand]).min()) if sand.any() else 0.0
    most = capacity // cell
    size, which = np.unique(lengths[~sand] // cell, return_inverse=True)
    dearest, n = np.zeros(len(size)), np.zeros(len(size), np.int64)
    np.maximum.at(dearest, which, prices[~sand])
    np.add.at(n, which, counts[~sand])
    best, _ = _tables(size, dearest, n, most)
    held = float((best + rate * (capacity - cell * np.arange(most + 1))).max())
    total = float((prices[~sand] * counts[~sand]).sum() + rate * (lengths[sand] * counts[sand]).sum())
    return total / held if held > 0 else 0.0


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, float, np.ndarray]:
    """(patterns, multiplicities, bound, group): the solved program over groups of lengths, and a certified lower bound.

    Multiplicities cover every group's items; the bound is the greatest of those of the prices of the rounds, of single
    large items and of plain volume.
    """
    group = grouped(lengths, counts)
    n = np.bincount(group, counts).astype(float)
    middle = np.bincount(group, lengths * counts) / n
    cell = _grid(capacity)
    room = capacity // cell
    sizes = np.clip(np.rint(middle / cell), 1, room).astype(np.int64)
    copies = n.astype(np.int64)
    log_weights = np.log(sizes / room * n)
    priced, at_prices, rounds, rate = 0.0, middle / capacity, ROUNDS, RATE
    while True:
        used: dict[tuple[tuple[int, int], ...], float] = {}
        covered, spent = np.zeros(len(n)), 0.0  # covered: share of each group's items that the patterns hold
        for _ in range(rounds):
            weights = np.exp(log_weights - log_weights.max())
            values = weights / n
            pattern = knapsack(sizes, values, copies, room)
            k, c = np.array(list(pattern)), np.array(list(pattern.values()))
            bound = float(weights.sum() / (values[k] * c).sum())
            if bound > priced:
                priced, at_prices = bound, values
            amount = float((n[k] / c).min())
            key = tuple(sorted(pattern.items()))
            used[key] = used.get(key, 0.0) + amount
            covered[k] += amount * c / n[k]
            log_weights[k] -= rate * amount * c / n[k]
            spent += amount
        low = covered.min()
        if low > 0 and spent / low <= (1 + GAP) * priced:
            break
        rounds, rate = int(rounds * MORE_ROUNDS), rate * LESS_RATE
    amounts = np.array(list(used.values())) / low
    bound = max(float((lengths * counts).sum() / capacity), float(counts[2 * lengths > capacity].sum()))
    for prices in (np.interp(lengths, middle, at_prices), at_prices[group]):
        bound = max(bound, certified_bound(lengths, counts, prices, capacity))
    return [dict(key) for key in used], amounts, bound, group


def rounded(patterns: list[dict[int, int]], amounts: np.ndarray, share: float, lengths: np.ndarray, counts: np.ndarray, group: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """((pattern of lengths, times), left): a share of the program's containers with real lengths, and the counts left over.

    Running sums of the multiplicities are rounded, so that many patterns of less than one container add up to whole ones.
    Places are filled from the longest group down with the longest length of the group that fits; a place of a group of
    which nothing fits is left empty, and so is the last one, whose length ``filled`` chooses to fit the room exactly.
    """
    left, size = counts.tolist(), lengths.tolist()
    begin = np.append(0, np.flatnonzero(np.diff(group)) + 1).tolist()
    open_ = [list(range(a, b)) for a, b in zip(begin, [*begin[1:], len(group)], strict=True)]
    out: list[tuple[dict[int, int], int]] = []
    total, given = 0.0, 0
    for pattern, amount in sorted(((sorted(p.items(), reverse=True), a) for p, a in zip(patterns, amounts, strict=True)), reverse=True):
        total += amount * share
        times = int(total + 0.5) - given
        given += times
        places = [*pattern[:-1], (pattern[-1][0], pattern[-1][1] - (sum(c for _, c in pattern) > 1))]
        while times > 0:
            one: dict[int, int] = {}
            room = capacity
            for g, c in places:
                upto = len(open_[g])
                while c > 0 and (upto := min(upto, bisect_right(open_[g], room, key=size.__getitem__))) > 0:
                    at = open_[g][upto - 1]
                    here = min(c, left[at], room // size[at])
                    one[at] = here
                    c, room, upto = c - here, room - here * size[at], upto - 1
            if not one:
                break
            run = min([times, *(left[i] // c for i, c in one.items())])
            for i, c in one.items():
                left[i] -= c * run
                if not left[i]:
                    own = open_[group[i]]
                    del own[bisect_right(own, i) - 1]
            out.append((one, run))
            times -= run
    return out, np.array(left, np.int64)


def filled(begun: list[tuple[dict[int, int], int]], lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The begun containers with the longest of what is left that fits, as often as it lasts."""
    left = left.copy()
    open_ = [int(k) for k in np.flatnonzero(left)]
    size = lengths.tolist()
    out = []
    for pattern, times in begun:
        stack = [(dict(pattern), times, capacity - sum(size[i] * c for i, c in pattern.items()), len(open_))]
        while stack:
            one, run, room, upto = stack.pop()
            upto = min(upto, len(open_))
            while room > 0 and upto > 0:
                upto = min(upto, bisect_right(open_, room, key=size.__getitem__))
                if not upto:
                    break
                i = open_[upto - 1]
                each = min(int(left[i]) // run, room // size[i])
                if each == 0:  # too few for all: some get one, the others go on without
                    some = int(left[i])
                    stack.append((dict(one), run - some, room, upto - 1))
                    run, each = some, 1
                one[i] = one.get(i, 0) + each
                left[i] -= each * run
                room -= each * size[i]
                if not left[i]:
                    del open_[upto - 1]
                    upto -= 1
                elif room < size[i]:
                    upto -= 1
            out.append((one, run))
    return out


def _largest_first(lengths: np.ndarray, counts: np.ndarray, capacity: int, paired: bool = False) -> Iterator[tuple[dict[int, int], int]]:
    """(pattern, times): containers filled with the largest length that still fits, repeated while counts last.

    paired: where that leaves room, the last item is exchanged for two that fit it exactly, if there are such.
    """
    left = {int(k): int(c) for k, c in enumerate(counts) if c > 0}
    index = {int(lengths[k]): k for k in left}
    open_ = sorted(index)
    there = np.zeros(capacity + 1, bool)
    there[open_] = True
    while open_:
        pattern, room, k, last = {}, capacity, len(open_), 0
        while k > 0:
            k = min(k, bisect_right(open_, room))
            if k == 0:
                break
            last = open_[k - 1]
            i = index[last]
            c = min(left[i], room // last)
            pattern[i] = c
            room -= c * last
            k -= 1
        if paired and room and len(pattern) > 1:
            whole = room + last
            both = np.flatnonzero(there[1 : whole // 2 + 1] & there[whole - 1 : whole - whole // 2 - 1 : -1]) + 1
            for a in both[::-1].tolist():
                one, two = index[a], index[whole - a]
                own = index[last]
                trial = dict(pattern)
                trial[own] -= 1
                for i in (one, two):
                    trial[i] = trial.get(i, 0) + 1
                if all(c <= left[i] for i, c in trial.items()):
                    pattern = {i: c for i, c in trial.items() if c}
                    break
        times = min(left[i] // c for i, c in pattern.items())
        for i, c in pattern.items():
            left[i] -= c * times
            if not left[i]:
                del open_[bisect_right(open_, int(lengths[i])) - 1]
                there[int(lengths[i])] = False
        yield pattern, times


@dataclass
class Plan:
    """Where the items of each length go: slots[length] = (first rank, first container, items per container) arrays.

    bound: containers that any packing needs; by_program: containers that patterns of the linear program fill;
    largest_first: containers of plain largest first on the same items.
    """

    containers: int
    bound: float
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    by_program: int = 0
    largest_first: int = 0


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Packs a histogram {length: items} with every length between 1 and the capacity."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    if not len(lengths):
        return Plan(0, 0.0, {})
    left, standing, bound, best = counts.copy(), [], 0.0, None
    for _ in range(PASSES):
        own = np.flatnonzero(left)
        if not len(own):
            break
        patterns, amounts, certified, group = solve_lp(lengths[own], left[own], capacity)
        bound = bound or certified
        begun, rest = rounded(patterns, amounts, SHARE, lengths[own], left[own], group, capacity)
        for pattern, times in filled(begun, lengths[own], rest, capacity):
            if sum(int(lengths[own[i]]) * c for i, c in pattern.items()) == capacity:
                standing.append(({int(own[i]): c for i, c in pattern.items()}, times))
                for i, c in pattern.items():
                    left[own[i]] -= c * times
        others = list(_largest_first(lengths, left, capacity, paired=True))
        by_program = sum(times for _, times in standing)
        total = by_program + sum(times for _, times in others)
        if best is None or total <= best[0]:
            best = total, by_program, [*standing, *others]
    _, by_program, used = best
    plain = sum(times for _, times in _largest_first(lengths, counts, capacity))
    rank = np.zeros(len(lengths), np.int64)
    rows: dict[int, list[tuple[int, int, int]]] = {}
    at = 0
    for pattern, times in used:
        for k, c in pattern.items():
            rows.setdefault(int(lengths[k]), []).append((int(rank[k]), at, c))
            rank[k] += c * times
        at += times
    if (rank != counts).any():
        raise AssertionError("the plan doesn't hold every item")
    return Plan(at, bound, {x: tuple(np.array(v, np.int64) for v in zip(*r, strict=True)) for x, r in rows.items()}, by_program, plain)


def container_of(plan: Plan, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The container of each item by its length and rank."""
    out = np.empty(len(length), np.int64)
    for x, own in pd.Series(length).groupby(length, sort=False).indices.items():
        first, container, per = plan.slots[int(x)]
        k = np.searchsorted(first, rank[own], side="right") - 1
        out[own] = container[k] + (rank[own] - first[k]) // per[k]
    return out


def pack(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, doc_id, piece_no, container_id, start_token, n_tokens): where every piece of every document goes.

    Containers F-<doc>-<piece> hold a full piece of one
    oversized document, P-<number> are packed.
    """
    limits = _limits(budgets)
    spark = documents.sparkSession
    schema = "budget_name string, doc_id long, piece_no int, container_id string, start_token long, n_tokens long"
    if not limits:
        return spark.createDataFrame([], schema)
    rows, cells, items = _items(documents, limits)
    full = rows.filter("full > 0").select("budget_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k")).select(
        "budget_name", "doc_id", F.col("k").cast("int").alias("piece_no"), F.concat(F.lit("F-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("container_id"),
        (F.col("k") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"),
    )
    plans = _plans(cells, limits)
    before = F.sum("n").over(Window.partitionBy("budget_name", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select("budget_name", "rest", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("budget_name", "rest", "salt").orderBy("doc_id")) - 1
    ranked = items.withColumn("place", place).join(offsets, ["budget_name", "rest", "salt"]).select("budget_name", "doc_id", "capacity", "full", "rest", (F.col("offset") + F.col("place")).alias("rank"))
    # plans are bounded by the capacities, not by the documents, and shipped in batches of at most MOST_RUNS
    batches: list[dict[str, Plan]] = []
    runs = 0
    for name, plan in plans.items():
        n = sum(len(first) for first, _, _ in plan.slots.values())
        if not batches or runs + n > MOST_RUNS:
            batches.append({})
            runs = 0
        batches[-1][name] = plan
        runs += n
    out = full
    for own in batches:
        shipped = spark.sparkContext.broadcast(own)

        def assign(frames: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            for b in frames:
                number = np.zeros(len(b), np.int64)
                for name, at in b.groupby("budget_name", sort=False).indices.items():
                    number[at] = container_of(shipped.value[name], b["rest"].to_numpy()[at], b["rank"].to_numpy()[at])
                yield pd.DataFrame({
                    "budget_name": b["budget_name"], "doc_id": b["doc_id"], "piece_no": b["full"].astype("int32"), "container_id": "P-" + pd.Series(number, index=b.index).astype(str),
                    "start_token": b["full"] * b["capacity"], "n_tokens": b["rest"],
                })

        mine = ranked if len(batches) == 1 else ranked.filter(F.col("budget_name").isin(*own))
        out = mine.mapInPandas(assign, schema).unionByName(out)
    return out


def _limits(budgets: DataFrame) -> dict[str, tuple[int, str]]:
    """(capacity, tokenizer) by budget; budgets are a small definition table (checked: at most 1000)."""
    limits: dict[str, tuple[int, str]] = {}
    named = budgets.select("budget_name", "tokenizer_name", "capacity_tokens").filter("budget_name is not null and capacity_tokens > 0").orderBy("capacity_tokens", "tokenizer_name").limit(1001).collect()
    if len(named) > 1000:
        raise ValueError("more than 1000 budgets")
    for b in named:
        if b.tokenizer_name not in TOKENIZERS:
            raise ValueError(f"no tokenizer {b.tokenizer_name!r}")
        if b.capacity_tokens > MAX_CAPACITY:
            raise ValueError(f"a capacity of {b.capacity_tokens} is above {MAX_CAPACITY}")
        limits.setdefault(b.budget_name, (b.capacity_tokens, b.tokenizer_name))
    return limits


def _items(documents: DataFrame, limits: dict[str, tuple[int, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents by budget, items by budget, length and salt, items): the texts are read once, only sizes are kept."""
    per_budget = F.array(*[F.struct(F.lit(n).alias("budget_name"), F.lit(c).cast("long").alias("capacity"), F.col(f"size_{t}").alias("size")) for n, (c, t) in limits.items()])
    sizes = durable(documents.filter("doc_id is not null").select("doc_id", *[TOKENIZERS[t](F.col("text")).alias(f"size_{t}") for t in {t for _, t in limits.values()}]))
    rows = sizes.select("doc_id", F.inline(per_budget)).withColumns({
        "full": F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("long"),
        "rest": F.when(F.col("size") > F.col("capacity"), F.col("size") % F.col("capacity")).otherwise(F.col("size")),
    })
    salts = SALTS_PER_PARTITION * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = rows.filter("rest > 0").select("budget_name", "doc_id", "capacity", "full", "rest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    return rows, items.groupBy("budget_name", "rest", "salt").agg(F.count(F.lit(1)).alias("n")), items


def _plans(cells: DataFrame, limits: dict[str, tuple[int, str]]) -> dict[str, Plan]:
    """The plan of each budget's histogram, whose rows are at most the sum of the capacities."""
    histograms: dict[str, dict[int, int]] = {}
    for r in cells.groupBy("budget_name", "rest").agg(F.sum("n").alias("n")).collect():
        histograms.setdefault(r.budget_name, {})[r.rest] = r.n
    return {b: make_plan(h, limits[b][0]) for b, h in sorted(histograms.items())}


def packing_report(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, capacity_tokens, n_full, n_packed, n_by_program, n_largest_first, bound, plain_volume): how good a packing is.

    n_full: containers that a piece of an oversized document fills; n_packed: the others; n_by_program: those of them that
    patterns of the linear program fill; n_largest_first: what the plain heuristic would need; bound: what any packing needs.
    """
    limits = _limits(budgets)
    schema = "budget_name string, capacity_tokens long, n_full long, n_packed long, n_by_program long, n_largest_first long, bound double, plain_volume double"
    spark = documents.sparkSession
    if not limits:
        return spark.createDataFrame([], schema)
    rows, cells, _ = _items(documents, limits)
    full = {r.budget_name: (r.n, r.tokens) for r in rows.groupBy("budget_name").agg(F.sum("full").alias("n"), F.sum("rest").alias("tokens")).collect()}
    plans = _plans(cells, limits)
    out = []
    for name, (n, tokens) in sorted(full.items()):
        p = plans.get(name, Plan(0, 0.0, {}))
        out.append((name, limits[name][0], n, p.containers, p.by_program, p.largest_first, p.bound, tokens / limits[name][0]))
    return spark.createDataFrame(out, schema)


def split_documents(packed: DataFrame) -> DataFrame:
    """(budget_name, doc_id): the documents whose pieces lie in more than one container."""
    both = packed.groupBy("budget_name", "doc_id").agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"))
    return both.filter("a <> b").select("budget_name", "doc_id")
