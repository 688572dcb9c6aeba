"""One ranking from pairwise comparisons: skew-symmetric spectral ranking.

Matches are reduced to one margin per pair of items, the shrunk log-odds of the pair's wins, and margins are divided by
the roots of both items' total absolute margin, so that an item that met many opponents weighs no more than one that met
few. Items that no chain of comparisons links can't be compared, so connected parts are labelled first (alternating
stars) and each gets a plane of its own. The matrix of normalised margins is skew-symmetric; its leading singular plane is
computed by Lanczos steps whose vectors stay distributed as arrays in a table of items: each step is one join of pairs and
items, one sum per item, and one aggregate row of inner products (against all earlier vectors, so the basis stays
orthogonal). Parts of at most SMALL_PART items other than the largest go through the same steps within a task each. In a
part's plane the direction without the constant part is taken as the start,
and among all directions the one whose order agrees with most outcomes orients the ranking: the angles at which pairs
flip cut the turn into sectors of one order each, and a running sum of what each flip changes finds the best.

Strengths are log-odds with mean 0 in each part; ``component`` tells the parts apart (0 is the largest), and strengths of
different parts are only on the same scale, not measured against each other. Lineage is cut by reliable checkpoints,
nothing is broadcast by hint, and only coefficients and the names of parts above SMALL_PART items reach the driver, whose
memory is the square of the number of steps between restarts. A plane that doesn't converge raises.

Defined results: comparisons without id, of an item with itself, or whose winner isn't one of the two don't count; of
differing rows of one id the least counts; items of a part whose margins are all even have strength 0; equal strengths
rank by name. No counting comparison gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.engine.shared import durable, trimmed

#: Steps of the Lanczos iteration between restarts from its planes, restarts at most, and the relative residual of a
#: plane at which it has converged; an offset of a basis vector from the earlier ones below which there is none.
MAX_STEPS, MAX_RESTARTS, TOLERANCE, NOTHING = 40, 50, 1e-7, 1e-9
#: Items of a part that one task may hold.
SMALL_PART = 2000
#: Wins added to either side of a pair, which keeps one-sided pairs finite.
SHRINK = 0.5
#: Decimals to which the angles at which a pair's order flips are told apart.
ANGLE_DECIMALS = 12
#: Pairs of a partition of the iteration.
PAIRS_PER_PARTITION = 50_000


def counted_matches(matches: DataFrame) -> DataFrame:
    """(match_id, a, b, a_won): each match that counts once; names in lower case without outer blanks."""
    name = lambda c: F.lower(trimmed(c))
    rows = matches.select("match_id", name("radiant_team").alias("a"), name("dire_team").alias("b"), name("winner").alias("w"))
    a_won = F.when((F.col("w") == F.col("a")) | (F.col("w") == "radiant"), True).when((F.col("w") == F.col("b")) | (F.col("w") == "dire"), False)
    rows = rows.withColumn("a_won", a_won).filter("match_id is not null and a <> '' and b <> '' and a <> b and a_won is not null")
    return rows.groupBy("match_id").agg(F.min(F.struct("a", "b", "a_won")).alias("m")).select("match_id", "m.*")


def pair_wins(won: DataFrame) -> DataFrame:
    """(a, b, wins_a, wins_b) with a < b, from rows (a, b, a_won)."""
    low = F.col("a") < F.col("b")
    first_won = F.col("a_won") == low
    return won.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum(F.when(first_won, 1).otherwise(0)).alias("wins_a"), F.sum(F.when(first_won, 0).otherwise(1)).alias("wins_b")
    )


def components(pairs: DataFrame) -> DataFrame:
    """(item, root): the connected part of every item of rows (a, b), named by its least item.

    Alternating large and small stars: every item's greater neighbours, then its lesser ones, are tied to the least item
    that it knows, until each is tied to its root. Rounds grow with the logarithm of the items.
    """
    edges = durable(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        edges = durable(small)
        # done when every item has one root and no root has one
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("is_u"), F.lit(0).alias("is_v")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("is_u"), F.lit(1).alias("is_v")))
        if not ends.groupBy("x").agg(F.sum("is_u").alias("us"), F.sum("is_v").alias("vs")).filter("us > 1 or (us > 0 and vs > 0)").limit(1).count():
            break
    own = edges.select(F.col("u").alias("item"), F.col("v").alias("root"))
    return own.unionByName(edges.select(F.col("v").alias("item"), F.col("v").alias("root")).distinct())


def _dot(coefficients: np.ndarray) -> Column:
    """The linear combination of the basis vectors in q, per item."""
    weights = F.array(*[F.lit(float(c)) for c in coefficients])
    return F.aggregate(F.zip_with("q", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _leading_plane(betas: list[float]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Two vectors that span the leading plane of the skew tridiagonal matrix, its singular value, and the residual."""
    k = len(betas)
    t = np.zeros((k, k))
    for i, b in enumerate(betas[:-1]):
        t[i + 1, i], t[i, i + 1] = b, -b
    values, vectors = np.linalg.eig(t)
    lead = int(np.argmax(values.imag))
    y = vectors[:, lead]
    p, _ = np.linalg.qr(np.column_stack([y.real, y.imag])) if k > 1 else (np.array([[1.0, 0.0]]), None)
    return p[:, 0], p[:, 1], float(values[lead].imag), float(betas[-1] * abs(y[-1]))


def _plane_of(start: Any, multiply: Callable, inner: Callable, extend: Callable, combine: Callable, count: int) -> tuple[Any, Any]:
    """The two vectors of the leading plane by Lanczos steps; what a vector is, the given operations know.

    multiply(basis) gives the product with the last vector; inner(basis, w) its inner products with the basis and itself;
    extend(basis, w, coefficients, beta) the basis with the rest of w; combine(basis, y) one vector of the basis.
    """
    basis = start
    for _ in range(MAX_RESTARTS + 1):
        betas: list[float] = []
        while True:
            basis, w = multiply(basis, len(betas))
            coefficients, square = inner(basis, w)
            beta = math.sqrt(max(square - sum(c * c for c in coefficients), 0.0))
            betas.append(beta if beta > NOTHING and len(betas) + 1 < count else 0.0)
            lead = _leading_plane(betas)
            if not betas[-1] or (len(betas) > 1 and lead[3] <= TOLERANCE * max(lead[2], 1e-12)):
                return combine(basis, lead[0]), combine(basis, lead[1])
            if len(betas) >= MAX_STEPS:
                break
            basis = extend(basis, w, coefficients, beta)
        basis = extend(combine(basis, lead[0]), None, None, None)
    raise RuntimeError(f"a leading plane has a residual of {lead[3] / lead[2]:.1e} after {MAX_RESTARTS} restarts")


def _small_planes(rows: pd.DataFrame) -> pd.DataFrame:
    """(item, p1, p2) of a part that fits in a task, from its normalised margins (item, other, m, q0)."""
    names, at = np.unique(rows["item"], return_inverse=True)
    other = np.searchsorted(names, rows["other"])
    m, n = rows["m"].to_numpy(), len(names)
    first = np.zeros(n)
    first[at] = rows["q0"]
    size = np.linalg.norm(first)
    vectors = _plane_of(
        [first / (size or 1.0)],
        lambda basis, k: (basis, np.bincount(at, m * basis[k][other], n)),
        lambda basis, w: ([float(w @ q) for q in basis], float(w @ w)),
        lambda basis, w, c, beta: [*basis, (w - sum(x * q for x, q in zip(c, basis, strict=True))) / beta] if w is not None else [basis],
        lambda basis, y: sum(x * q for x, q in zip(y, basis, strict=True)),
        n,
    )
    return pd.DataFrame({"item": names, "p1": vectors[0], "p2": vectors[1]})


def _large_plane(items: DataFrame, scaled: DataFrame, count: int) -> DataFrame:
    """(item, p1, p2) of one part, its vectors distributed."""
    norm = items.agg(F.sqrt(F.sum(F.col("q0") * F.col("q0")))).first()[0]
    start = items.select("item", F.array(F.col("q0") / F.lit(norm or 1.0)).alias("q"))

    def multiply(state: DataFrame, k: int) -> tuple[DataFrame, int]:
        product = scaled.join(state.select(F.col("item").alias("other"), F.get("q", F.lit(k)).alias("x")), "other").groupBy("item").agg(F.sum(F.col("m") * F.col("x")).alias("w"))
        return durable(state.join(product, "item", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))), k + 1

    def inner(state: DataFrame, k: int) -> tuple[list[float], float]:
        return tuple(state.agg(F.array(*[F.sum(F.col("w") * F.get("q", F.lit(i))) for i in range(k)]), F.sum(F.col("w") * F.col("w"))).first())

    def extend(state: DataFrame, w: Any, coefficients: list[float] | None, beta: float | None) -> DataFrame:
        if w is None:
            return state
        return state.select("item", F.concat("q", F.array((F.col("w") - _dot(np.array(coefficients))) / beta)).alias("q"))

    def combine(state: DataFrame, y: np.ndarray) -> DataFrame:
        return state.select("item", F.array(_dot(y)).alias("q"))

    one, two = _plane_of(start, multiply, inner, extend, combine, count)
    return one.select("item", F.get("q", F.lit(0)).alias("p1")).join(two.select("item", F.get("q", F.lit(0)).alias("p2")), "item")


def _margins(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs with margin and part, both sides of each pair, items with part, games, wins, scale and start)."""
    pairs = durable(pairs.withColumn("m", F.log((F.col("wins_a") + SHRINK) / (F.col("wins_b") + SHRINK))))
    roots = components(pairs)
    sides = F.array(
        F.struct(F.col("a").alias("item"), F.col("b").alias("other"), F.col("m").alias("m"), F.col("wins_a").alias("wins")),
        F.struct(F.col("b").alias("item"), F.col("a").alias("other"), (-F.col("m")).alias("m"), F.col("wins_b").alias("wins")),
    )
    both = pairs.select(F.inline(sides), (F.col("wins_a") + F.col("wins_b")).alias("games"))
    weights = both.groupBy("item").agg(F.sum(F.abs("m")).alias("d"), F.sum("games").alias("games"), F.sum("wins").alias("wins"), F.sum("m").alias("total"))
    items = durable(weights.join(roots, "item").select("item", "root", "games", "wins", F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(1.0).alias("s"), (F.col("total") + 0.01 * F.pmod(F.xxhash64("item"), F.lit(1009)) / 1009).alias("q0")))
    return pairs, both, items


def _spanned(items: DataFrame, scaled: DataFrame) -> DataFrame:
    """(item, root, games, wins, s, p1, p2): each item's coordinates in the leading plane of its part."""
    sizes = durable(items.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    large = {r.root: r.n for r in sizes.filter(F.col("n") > SMALL_PART).collect()} or {r.root: r.n for r in sizes.orderBy(F.col("n").desc(), "root").limit(1).collect()}
    planes = []
    for root, n in sorted(large.items()):
        planes.append(_large_plane(items.filter(F.col("root") == root), scaled.filter(F.col("root") == root), n))
    rest = scaled.filter(~F.col("root").isin(*large)).join(items.select("item", "q0"), "item").select("root", "item", "other", "m", "q0")
    planes.append(rest.groupBy("root").applyInPandas(_small_planes, "item string, p1 double, p2 double"))
    found = planes[0]
    for more in planes[1:]:
        found = found.unionByName(more)
    return durable(items.select("item", "root", "games", "wins", "s").join(found, "item"))


def spectral_ranking(pairs: DataFrame) -> DataFrame:
    """(item, strength, games, wins, component, rank) from pair_wins; rank 1 is the strongest."""
    pairs, both, items = _margins(pairs)
    if not pairs.limit(1).count():
        return items.select("item", F.lit(0.0).alias("strength"), "games", "wins", F.lit(0).alias("component"), F.lit(1).alias("rank"))
    partitions = 1 + pairs.count() // PAIRS_PER_PARTITION
    scaled = both.join(items.select(F.col("item").alias("other"), F.col("s").alias("s2")), "other").join(items.select("item", "root", "s"), "item").select("root", "item", "other", (F.col("m") * F.col("s") * F.col("s2")).alias("m"))
    scaled = durable(scaled.repartition(partitions, "other"))
    plane = _spanned(items.withColumn("q0", F.col("q0") * F.col("s")), scaled)
    constant = plane.groupBy("root").agg(F.sum(F.col("p1") / F.col("s")).alias("c1"), F.sum(F.col("p2") / F.col("s")).alias("c2"))
    size = F.hypot("c1", "c2")
    c1, c2 = F.when(size > 0, F.col("c1") / size).otherwise(0.0), F.when(size > 0, F.col("c2") / size).otherwise(0.0)
    # u has no constant part in the plane, v is the rest; both are taken back from normalised to plain units
    plane = durable(plane.join(constant.select("root", c1.alias("c1"), c2.alias("c2")), "root").select(
        "item", "root", "games", "wins", ((F.col("p2") * F.col("c1") - F.col("p1") * F.col("c2")) * F.col("s")).alias("u"), ((F.col("p1") * F.col("c1") + F.col("p2") * F.col("c2")) * F.col("s")).alias("v"),
    ))
    ends = pairs.join(plane.select(F.col("item").alias("a"), "root", F.col("u").alias("ua"), F.col("v").alias("va")), "a").join(plane.select(F.col("item").alias("b"), F.col("u").alias("ub"), F.col("v").alias("vb")), "b")
    gaps = durable(ends.select("root", (F.col("ua") - F.col("ub")).alias("du"), (F.col("va") - F.col("vb")).alias("dv"), "wins_a", "wins_b", "m"))
    angles = best_directions(gaps)
    x = F.col("du") * F.cos("angle") + F.col("dv") * F.sin("angle")
    games = F.col("wins_a") + F.col("wins_b")
    units = gaps.join(angles, "root").groupBy("root", "angle").agg(F.sum(games * F.col("m") * x).alias("up"), F.sum(games * x * x).alias("down"))
    units = units.select("root", "angle", F.when(F.col("down") > 0, F.col("up") / F.col("down")).otherwise(0.0).alias("unit"))
    raw = durable(plane.join(units, "root").select("item", "root", "games", "wins", ((F.col("u") * F.cos("angle") + F.col("v") * F.sin("angle")) * F.col("unit")).alias("raw")))
    middles = raw.groupBy("root").agg(F.avg("raw").alias("middle"), F.count(F.lit(1)).alias("n"))
    named = _numbered(middles, [F.col("n").desc(), F.col("root")], "component").select("root", "middle", "component")
    strengths = raw.join(named, "root").select("item", (F.col("raw") - F.col("middle")).alias("strength"), "games", "wins", "component")
    ranked = _numbered(strengths, [F.col("strength").desc(), F.col("item")], "rank")
    return ranked.select("item", "strength", "games", "wins", "component", (F.col("rank") + 1).alias("rank"))


def best_directions(gaps: DataFrame) -> DataFrame:
    """(root, angle): of each part the middle of the sector whose order agrees with most outcomes; of equals the nearest to 0.

    Flips are sorted in ranges, so that no task holds all of a large part; only the change against the first sector counts.
    """
    turn = 2 * math.pi
    lean = F.col("wins_a") - F.col("wins_b")
    up = F.atan2(-F.col("du"), F.col("dv"))
    flips = F.array(F.struct(up.alias("t"), (2 * lean).alias("change")), F.struct(F.when(up > 0, up - math.pi).otherwise(up + math.pi).alias("t"), (-2 * lean).alias("change")))
    t = F.round("t", ANGLE_DECIMALS)
    end = round(math.pi, ANGLE_DECIMALS)
    moving = gaps.filter((F.col("du") != 0) | (F.col("dv") != 0))
    changes = moving.select("root", F.inline(flips)).groupBy("root", F.when(t <= -end, end).otherwise(t).alias("t")).agg(F.sum("change").alias("change"))
    parts = durable(changes.repartitionByRange("root", "t").withColumn("part", F.spark_partition_id()))
    ranges = parts.groupBy("root", "part").agg(F.sum("change").alias("change"), F.min("t").alias("first"))
    w = Window.partitionBy("root").orderBy("part")  # at most as many rows as there are partitions
    ranges = ranges.select(
        "root", "part", F.coalesce(F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.coalesce(F.lead("first").over(w), F.min("first").over(Window.partitionBy("root")) + turn).alias("following"),
    )
    own = Window.partitionBy("root", "part").orderBy("t")
    sectors = parts.join(ranges, ["root", "part"]).select("root", "t", (F.col("before") + F.sum("change").over(own)).alias("score"), F.coalesce(F.lead("t").over(own), F.col("following")).alias("to"))
    middle = (F.col("t") + F.col("to")) / 2
    middle = F.when(middle > math.pi, middle - turn).otherwise(middle)
    far = F.greatest(F.abs(middle) - (F.col("to") - F.col("t")) / 2, F.lit(0.0))
    best = sectors.groupBy("root").agg(F.max(F.struct("score", -far, middle.alias("middle"))).alias("best"))
    return gaps.select("root").distinct().join(best, "root", "left").select("root", F.coalesce("best.middle", F.lit(0.0)).alias("angle"))


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers rows in order from 0 without moving all into one task: ranges are sorted apart and offset by the sizes before."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = durable(ordered.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    sizes = {r["_part"]: r.n for r in ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, pairs = 0, []
    for part in sorted(sizes):
        pairs += [F.lit(part), F.lit(before)]
        before += sizes[part]
    offset = F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)
    in_part = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn(name, (offset + in_part).cast("int")).drop("_part", "_place")


def rank_teams(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """(team_name, strength, games, wins, component, rank): every team of ``teams`` with a counting match, spelled as there."""
    ranked = spectral_ranking(pair_wins(counted_matches(matches)))
    names = teams.filter("team_name is not null").groupBy(F.lower(trimmed("team_name")).alias("item")).agg(F.min("team_name").alias("team_name"))
    return ranked.join(names, "item").select("team_name", "strength", "games", "wins", "component", "rank")
