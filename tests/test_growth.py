import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonalis.operators import growth
from zonalis.operators.growth import Graph


def graph(edges, people, loops=None, at=None):
    g = Graph(people=people, loop=dict(loops or {}), at=dict(at or {}))
    for a, b, w in edges:
        g.add(a, b, w)
    return g


def test_prune_keeps_seeds_and_capture():
    g = graph([("seed_a", "seed_b", 50), ("seed_a", "core_1", 30), ("seed_b", "core_1", 20), ("seed_a", "low_value_large", 1), ("seed_b", "low_value_small", 5)], {"seed_a": 100, "seed_b": 100, "core_1": 100, "low_value_large": 300, "low_value_small": 200}, {"seed_a": 10, "seed_b": 10, "core_1": 4})
    z = growth.mobility_prune(g, ["seed_a", "seed_b"], mobility_prune_min_seed_capture=0.97)
    assert z.cluster == ["core_1", "low_value_small", "seed_a", "seed_b"] and z.population == 500
    assert z.info["initial_population"] == 800 and z.info["reduced_population"] == 300 and z.info["removed"] == 1 and z.info["stopped_by_seed_capture_floor"]


def test_prune_does_not_disconnect():
    g = graph([("seed", "bridge", 1), ("bridge", "leaf", 100)], {"seed": 100, "bridge": 100, "leaf": 300})
    z = growth.mobility_prune(g, ["seed"])
    assert z.cluster == ["bridge", "seed"] and z.population == 200


def test_prune_takes_remote_areas_away():
    g = graph([("seed", "strong_a", 50), ("seed", "strong_b", 40), ("seed", "weak_bridge", 1), ("weak_bridge", "remote_huge", 1)], {"seed": 200, "strong_a": 300, "strong_b": 200, "weak_bridge": 300, "remote_huge": 1_000_000})
    z = growth.mobility_prune(g, ["seed"], mobility_prune_min_seed_capture=0.95)
    assert z.cluster == ["seed", "strong_a", "strong_b"] and z.population == 700
    assert z.info["target_population"] == 100_000 and z.info["initial_cbgs"] == 5 and z.info["removed"] == 2


def test_prune_without_a_known_seed():
    with pytest.raises(ValueError):
        growth.mobility_prune(graph([("a", "b", 1)], {}), ["x"])


def test_names_and_ranges():
    assert growth.algorithm(" Reverse_Prune ") == "mobility_prune"
    assert set(growth.ALIASES.values()) <= set(growth.METHODS)
    with pytest.raises(ValueError):
        growth.algorithm("hierarchical")
    with pytest.raises(ValueError):
        growth.parameters({"distance_scale_km": 0})
    assert growth.parameters({"mobility_prune_min_czi": 0.5})["mobility_prune_min_seed_capture"] == 0.5


def test_ties_go_to_the_fixed_side():
    g = graph([("s", "b", 5), ("s", "a", 5)], {"s": 1, "a": 1, "b": 1})
    assert growth.greedy_weight(g, "s", 2).cluster == ["s", "a"]
    assert growth.greedy_weight_seed_guard(g, "s", 2).cluster == ["s", "b"]


edges = st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg"), st.integers(1, 20)), min_size=4, max_size=18)


@settings(max_examples=40, deadline=None)
@given(edges, st.lists(st.integers(1, 9), min_size=7, max_size=7), st.integers(3, 25))
def test_best_zone_is_the_best_of_all(edge, people, cap):
    g = graph([("a", "b", 1), *edge], dict(zip("abcdefg", people, strict=True)))
    z = growth.czi_optimal_cap(g, "a", cap, optimal_candidate_limit=20, optimal_max_iters=30, optimal_mip_rel_gap=0.0)
    assert not z.info["fallback"] and z.info["proven"]
    low, high = z.info["population_floor"], z.info["population_cap"]
    pool = [x for x in g.near if x != "a"]
    best = max((growth._czi(g, {"a", *some}) for n in range(len(pool) + 1) for some in itertools.combinations(pool, n) if low <= g.population("a") + sum(map(g.population, some)) <= high and growth._holds(g, {"a", *some}, {"a"})), default=0.0)
    assert abs(z.info["czi"] - best) < 1e-3


@settings(max_examples=40, deadline=None)
@given(edges, st.integers(3, 60))
def test_grown_zones_are_connected(edge, least):
    g = graph([("a", "b", 1), *edge], dict.fromkeys("abcdefg", 10))
    for f in (growth.greedy_fast, growth.greedy_weight, growth.greedy_ratio, growth.czi_balanced, growth.greedy_ttwa):
        z = f(g, "a", least)
        assert z.cluster[0] == "a" and len(set(z.cluster)) == len(z.cluster) and growth._holds(g, set(z.cluster), {"a"})


def test_best_zone_of_a_full_pool():
    """At the default pool of 120 areas no zone that the growing rules find is better."""
    rows = random.Random(7)
    at = {f"{i:03}": (rows.random(), rows.random()) for i in range(130)}
    pairs = [(a, b, 30 / (0.02 + (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2)) for a, b in itertools.combinations(at, 2) if rows.random() < 0.2]
    g = graph(pairs, {c: rows.randint(500, 2000) for c in at}, {c: rows.randint(10, 3000) for c in at})
    z = growth.czi_optimal_cap(g, "000", 30_000, optimal_time_limit_sec=2)
    assert not z.info["fallback"] and z.info["candidates"] == 120 and 27_000 <= z.population <= 30_000
    assert growth._holds(g, set(z.cluster), {"000"})
    pool = set(growth._best_first(g, "000", 120))
    for f in (growth.czi_balanced, growth.greedy_weight, growth.greedy_ratio):
        grown = f(g, "000", 27_000)
        assert not set(grown.cluster) <= pool or grown.population > 30_000 or z.info["czi"] >= growth._czi(g, set(grown.cluster)) - 1e-9
