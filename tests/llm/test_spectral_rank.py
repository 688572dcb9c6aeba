import math
import random

import numpy as np
import pytest

from tallyspark.llm import spectral_rank as R

MATCHES = "match_id long, radiant_team string, dire_team string, winner string, a int, b int, w string, item string"


def matches(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", "clash") for r in rows], MATCHES)


def teams(spark, names):
    return spark.createDataFrame([(n, "x") for n in names], "team_name string, item string")


def test_which_matches_count(spark):
    m = matches(spark, [
        (1, "Red", "Blue", " red "), (1, "Red", "Blue", " red "), (2, "Red", "Blue", "Dire"), (3, "Red", " RED", "Red"), (4, "Red", "Blue", None), (5, "Red", "Blue", "draw"), (6, None, "Blue", "Blue"), (None, "Red", "Blue", "Red"),
        (7, "Red", "Blue", ""), (8, "Blue", "Red", "Radiant"),
    ])
    got = sorted((r.match_id, r.a, r.b, r.a_won) for r in R.counted_matches(m).collect())
    assert got == [(1, "red", "blue", True), (2, "red", "blue", False), (8, "blue", "red", True)]


def schedule(n, games, seed, gap=0.35):
    """Uneven games between n teams of known strengths; strong teams meet strong ones more often."""
    rng = random.Random(seed)
    strength = {f"Team {k:02d}": (n / 2 - k) * gap for k in range(n)}
    names, out = list(strength), []
    for g in range(games):
        i = min(int(rng.expovariate(0.15)), n - 1)
        j = min(max(0, i + rng.choice([-3, -2, -1, 1, 2, 3, 6])), n - 1)
        if i != j:
            p = 1 / (1 + math.exp(strength[names[j]] - strength[names[i]]))
            out.append((g, names[i], names[j], names[i] if rng.random() < p else names[j]))
    return strength, out


def test_recovers_known_strengths_from_an_uneven_schedule(spark):
    strength, rows = schedule(12, 6000, 1)
    got = {r.team_name: r for r in R.rank_teams(matches(spark, rows), teams(spark, strength)).collect()}
    order = sorted(got, key=lambda t: got[t].rank)
    assert [got[t].rank for t in order] == list(range(1, len(order) + 1))
    assert np.corrcoef([strength[t] for t in got], [got[t].strength for t in got])[0, 1] > 0.9
    assert set(order[:3]) <= {f"Team {k:02d}" for k in range(5)}


def test_plane_is_the_leading_one(spark):
    """The ranking by Lanczos steps is the one that a dense decomposition of the same matrix gives."""
    _, rows = schedule(9, 1500, 2)
    pairs = R.pair_wins(R.counted_matches(matches(spark, rows)))
    data = pairs.collect()
    names = sorted({x for r in data for x in (r.a, r.b)})
    m = np.zeros((len(names),) * 2)
    for r in data:
        i, j = names.index(r.a), names.index(r.b)
        m[i, j] = math.log((r.wins_a + 0.5) / (r.wins_b + 0.5))
        m[j, i] = -m[i, j]
    s = 1 / np.sqrt(np.abs(m).sum(1))
    u, _, v = np.linalg.svd(s[:, None] * m * s[None, :])
    q, _ = np.linalg.qr(np.column_stack([u[:, 0], v[0]]))
    got = {r.item: r.strength for r in R.spectral_ranking(pairs).collect()}
    x = np.array([got[n] for n in names])
    # strengths are a direction of the plane in plain units, less their mean
    basis = np.column_stack([s[:, None] * q, np.ones(len(names))])
    rest = x - basis @ np.linalg.lstsq(basis, x, rcond=None)[0]
    assert np.abs(rest).max() < 1e-5 * np.abs(x).max()


def test_ties_two_teams_and_empty(spark):
    one = R.rank_teams(matches(spark, [(1, "A", "B", "A")]), teams(spark, ["A", "B", "C"])).collect()
    assert {r.team_name: r.rank for r in one} == {"A": 1, "B": 2}
    even = R.rank_teams(matches(spark, [(1, "A", "B", "A"), (2, "A", "B", "B")]), teams(spark, ["A", "B"])).collect()
    assert {r.team_name: (r.rank, r.strength) for r in even} == {"A": (1, 0.0), "B": (2, 0.0)}
    assert R.rank_teams(matches(spark, []), teams(spark, ["A"])).collect() == []
    assert R.rank_teams(matches(spark, [(1, "A", "B", "A")]), teams(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_order_of_rows_doesnt_matter(spark, seed):
    _, rows = schedule(6, 300, 3)
    a = {r.team_name: r.rank for r in R.rank_teams(matches(spark, rows), teams(spark, [f"Team {k:02d}" for k in range(6)])).collect()}
    random.Random(seed).shuffle(rows)
    b = {r.team_name: r.rank for r in R.rank_teams(matches(spark, rows + rows[:40]), teams(spark, [f"Team {k:02d}" for k in range(6)])).collect()}
    assert a == b


@pytest.mark.parametrize("seed", range(3))
def test_direction_agrees_with_most_outcomes(spark, seed):
    """No order that a direction of the plane can give has more agreement; some sectors are narrower than any grid."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 2)) * [1, 1e-3]
    gaps = [(*(x[i] - x[j]).tolist(), int(rng.integers(9)), int(rng.integers(9)), 0.0) for i in range(40) for j in range(i)] + [(0.0, 0.0, 5, 1, 0.0)]
    got = R.best_directions(spark.createDataFrame([("p", *g) for g in gaps] + [("q", 0.0, 0.0, 3, 1, 0.0)], "root string, du double, dv double, wins_a long, wins_b long, m double"))
    got = {r.root: r.angle for r in got.collect()}
    assert got["q"] == 0.0
    got = got["p"]
    du, dv, a, b, _ = np.array(gaps).T
    score = lambda t: (np.sign(du * math.cos(t) + dv * math.sin(t)) * (a - b)).sum()
    flips = np.arctan2(-du, dv)[:-1]
    flips = np.sort(np.concatenate([flips, flips + math.pi]) % (2 * math.pi))
    assert score(got) == max(score(t) for t in (flips + np.append(flips[1:], flips[0] + 2 * math.pi)) / 2)


def test_lanczos_goes_on_until_the_plane_holds(spark, monkeypatch):
    _, rows = schedule(9, 1500, 2)
    pairs = R.pair_wins(R.counted_matches(matches(spark, rows)))
    whole = {r.item: r.strength for r in R.spectral_ranking(pairs).collect()}
    monkeypatch.setattr(R, "MAX_STEPS", 6)
    got = {r.item: r.strength for r in R.spectral_ranking(pairs).collect()}
    assert got == pytest.approx(whole, abs=1e-4)
    monkeypatch.setattr(R, "MAX_RESTARTS", 0)
    with pytest.raises(RuntimeError, match="residual"):
        R.spectral_ranking(pairs)


def test_parts_are_ranked_apart(spark):
    """An isolated pair, even a lopsided one, changes nothing among the others, and is told apart."""
    rounds = [(100 * i + j, f"t{i}", f"t{j}", f"t{max(i, j)}") for i in range(8) for j in range(8) if i != j]
    alone = R.spectral_ranking(R.pair_wins(R.counted_matches(matches(spark, rounds)))).collect()
    pair = [(5000 + k, "x1", "x2", "x1") for k in range(9)] + [(6000, "y1", "y2", "y2"), (6001, "y2", "y3", "y3")]
    both = R.spectral_ranking(R.pair_wins(R.counted_matches(matches(spark, rounds + pair)))).collect()
    own = {r.item: r for r in both}
    assert [r.item for r in sorted(alone, key=lambda r: r.rank)] == [f"t{k}" for k in range(7, -1, -1)]
    assert [r.item for r in sorted(both, key=lambda r: r.rank) if r.item[0] == "t"] == [f"t{k}" for k in range(7, -1, -1)]
    for r in alone:
        assert own[r.item].strength == pytest.approx(r.strength, abs=1e-6)
    assert {own[f"t{k}"].component for k in range(8)} == {0} and {own[k].component for k in ("y1", "y2", "y3")} == {1} and {own["x1"].component, own["x2"].component} == {2}
    assert own["x1"].strength > 0 > own["x2"].strength and own["y3"].strength > own["y2"].strength > own["y1"].strength
    assert sorted(r.rank for r in both) == list(range(1, 14))


def test_components_of_chains_stars_and_loose_pairs(spark):
    rng = random.Random(2)
    edges = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(70)] + [("hub", f"leaf{k}") for k in range(30)] + [("p", "q"), ("q", "p")]
    rng.shuffle(edges)
    got = {r.item: r.root for r in R.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len(got) == 71 + 31 + 2
    assert {v for k, v in got.items() if k[0] == "c"} == {"c000"} and {v for k, v in got.items() if k.startswith(("hub", "leaf"))} == {"hub"} and got["q"] == got["p"] == "p"
