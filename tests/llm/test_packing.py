import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import packing as P

DOCS = "doc_id long, text string, rest int, salt string, capacity int"


def packed(spark, texts, capacities, **more):
    docs = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in enumerate(texts)], DOCS)
    budgets = spark.createDataFrame([(n, "byt5", c) for n, c in capacities], "budget_name string, tokenizer_name string, capacity_tokens long")
    return P.pack(docs, budgets)


def check(rows, texts, limits):
    """Every token of every document lies in one container, none is overfull, and only large documents are split."""
    load, pieces = Counter(), defaultdict(list)
    for r in rows:
        load[r.budget_name, r.container_id] += r.n_tokens
        pieces[r.budget_name, r.doc_id].append((r.start_token, r.n_tokens, r.container_id))
    for name, limit in limits.items():
        for k, t in enumerate(texts):
            size = len((t or "").encode()) + 1
            own = sorted(pieces[name, k])
            assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][0] + own[-1][1] == size
            assert len(own) == -(-size // limit) and len({c for *_, c in own}) == len(own)
        assert max(v for (n, _), v in load.items() if n == name) <= limit
    return load


def test_packs_everything_whole(spark):
    rng = random.Random(3)
    texts = ["a" * rng.choice([3, 40, 41, 90, 150, 333, 999, 1000, 2500]) for _ in range(900)] + ["é" * 500, None, "", "x" * 999, "x" * 1999, "x" * 100_000]
    limits = {"small": 100, "large": 1000}
    load = check(packed(spark, texts, list(limits.items())).collect(), texts, limits)
    total = sum(len((t or "").encode()) + 1 for t in texts)
    for name, limit in limits.items():
        assert sum(1 for n, _ in load if n == name) <= 1.03 * total / limit + 1
    found = {(r.budget_name, r.doc_id) for r in P.split_documents(packed(spark, texts, list(limits.items()))).collect()}
    assert found == {(n, k) for n, c in limits.items() for k, t in enumerate(texts) if len((t or "").encode()) + 1 > c}


def test_one_length_may_hold_all_documents(spark):
    texts = ["same text"] * 3000
    load = check(packed(spark, texts, [("b", 35)]).collect(), texts, {"b": 35})
    assert len(load) == 1000


def test_empty_tables_and_odd_budgets(spark):
    assert packed(spark, [], [("b", 10)]).collect() == []
    assert packed(spark, ["a"], []).collect() == []
    assert packed(spark, ["a"], [(None, 10), ("z", None), ("n", -1)]).collect() == []
    assert {r.n_tokens for r in packed(spark, ["a"], [("b", 10), ("b", 5)]).collect()} == {2}
    budgets = spark.createDataFrame([("b", "other", 10)], "budget_name string, tokenizer_name string, capacity_tokens long")
    with pytest.raises(ValueError, match="tokenizer"):
        P.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), budgets)


def normal(seed, capacity, n):
    rng = random.Random(seed)
    sizes = [min(capacity, max(1, int(rng.lognormvariate(math.log(capacity / 8), 1.1)))) for _ in range(n)]
    return dict(Counter(sizes))


@pytest.mark.parametrize("scale", [1, 10, 1000])
@pytest.mark.parametrize("capacity", [512, 3000, 20_000])
def test_never_worse_than_largest_first_and_led_by_the_program(capacity, scale):
    histogram = {x: n * scale for x, n in normal(capacity, capacity, 1500).items()}
    plan = P.make_plan(histogram, capacity)
    assert plan.bound <= plan.containers <= plan.largest_first
    assert plan.by_program > 0.2 * plan.containers or plan.containers - plan.bound < 1.5
    assert sum(x * n for x, n in histogram.items()) / capacity <= plan.bound + 1e-9


def test_bound_is_above_volume_where_volume_is_loose():
    histogram = {1300: 500, 1301: 300, 1100: 50, 90: 200}
    plan = P.make_plan(histogram, 2048)
    assert plan.bound == pytest.approx(850) and plan.containers == 850
    thirds = P.make_plan({690: 900}, 2048)  # two fit, not three
    assert thirds.bound == pytest.approx(450) and thirds.containers == 450


def test_program_is_solved_to_its_gap():
    """The value of the patterns is within the stated gap of the optimum that a large number of rounds reaches."""
    lengths, counts = np.array([30, 41, 52, 70]), np.array([400, 300, 200, 100])
    patterns, amounts, bound, group = P.solve_lp(lengths, counts, 100)
    covered = sum(a * np.array([p.get(k, 0) for k in range(group.max() + 1)]) for p, a in zip(patterns, amounts))
    assert (covered >= np.bincount(group, counts) - 1e-6).all()
    assert bound <= amounts.sum()


def test_large_capacities_are_planned_in_time():
    began = time.perf_counter()
    histogram = {int(x): 3 for x in np.random.default_rng(1).integers(1, 1 << 20, 20_000)}
    plan = P.make_plan(histogram, 1 << 20)
    assert plan.containers <= plan.largest_first and time.perf_counter() - began < 60


def test_report(spark):
    docs = spark.createDataFrame([(1, "a" * 250), (2, "b" * 40), (3, None)], "doc_id long, text string")
    budgets = spark.createDataFrame([("b", "byt5", 100)], "budget_name string, tokenizer_name string, capacity_tokens long")
    r = P.packing_report(docs, budgets).first()
    assert (r.n_full, r.n_packed, r.n_largest_first, r.bound, r.plain_volume) == (2, 1, 1, 1.0, 0.93)
    assert P.packing_report(docs.limit(0), budgets).collect() == [] and P.packing_report(docs, budgets.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=25))
def test_plans_hold_every_item_and_bound_holds(histogram):
    plan = P.make_plan(histogram, 60)
    fill = Counter()
    for x, n in histogram.items():
        for c in P.container_of(plan, np.full(n, x), np.arange(n)):
            fill[c] += x
    assert max(fill.values()) <= 60 and set(fill) == set(range(plan.containers))
    assert plan.bound <= plan.containers + 1e-9
    assert plan.bound >= sum(x * n for x, n in histogram.items()) / 60 - 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 20), st.integers(1, 3)), min_size=1, max_size=6, unique_by=lambda t: t[0]), st.integers(5, 30))
def test_knapsack_against_brute_force(items, capacity):
    lengths, values, counts = (np.array(v) for v in zip(*items))
    got = P.knapsack(lengths, values.astype(float), counts, capacity)
    assert all(got[k] <= counts[k] for k in got) and sum(int(lengths[k]) * c for k, c in got.items()) <= capacity
    best = {0: 0}
    for x, v, n in items:
        for _ in range(n):
            best = {**best, **{s + x: max(best.get(s + x, 0), w + v) for s, w in best.items() if s + x <= capacity}}
    assert sum(int(values[k]) * c for k, c in got.items()) == max(best.values())
