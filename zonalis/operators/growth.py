"""Zone-building methods.

Each step depends on the last, so a run is one kernel over its own bounded
neighbourhood; many runs (seeds, rules, parameters) go in parallel, a group each. The
steps' scores are those of ``zones.frontier``. Ties have a fixed order, so a result does
not depend on rows' order or partitions.

``NEIGHBOURHOOD_ROWS`` bounds what one run may load; ``build`` raises beyond it, rather
than cut a graph silently.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEIGHBOURHOOD_ROWS = 5_000_000
#: Other names by which callers may ask for an algorithm.
ALIASES = {
    "balanced": "czi_balanced", "czi": "czi_balanced", "czi_balanced": "czi_balanced", "optimal": "czi_optimal_cap", "rigorous": "czi_optimal_cap", "milp": "czi_optimal_cap",
    "czi_optimal_cap": "czi_optimal_cap", "fast": "greedy_fast", "greedy_fast": "greedy_fast", "weight": "greedy_weight", "greedy_weight": "greedy_weight",
    "seed_guard": "greedy_weight_seed_guard", "weight_guard": "greedy_weight_seed_guard", "greedy_weight_seed_guard": "greedy_weight_seed_guard", "ratio": "greedy_ratio",
    "greedy_ratio": "greedy_ratio", "ttwa": "greedy_ttwa", "greedy_ttwa": "greedy_ttwa", "prune": "mobility_prune", "mobility_pruning": "mobility_prune",
    "reverse_prune": "mobility_prune", "movement_prune": "mobility_prune", "mobility_prune": "mobility_prune",
}
#: Lowest, highest and default value of each parameter.
PARAMETERS = {
    "distance_penalty_weight": (0.0, 1.0, 0.02), "distance_scale_km": (0.1, 500.0, 20.0), "seed_guard_distance_km": (0.0, 500.0, 20.0), "containment_threshold": (0.0, 1.0, 0.70),
    "mobility_prune_min_seed_capture": (0.0, 1.0, 0.80), "optimal_candidate_limit": (20, 400, 120), "optimal_population_floor_ratio": (0.0, 1.0, 0.9),
    "optimal_mip_rel_gap": (0.0, 0.2, 0.02), "optimal_time_limit_sec": (1, 300, 20), "optimal_max_iters": (1, 30, 8),
}


def algorithm(name: str) -> str:
    """The algorithm of that name or alias; ``ValueError`` for others."""
    found = ALIASES.get(str(name).strip().lower())
    if found is None:
        raise ValueError(f"unknown algorithm {name}")
    return found


def parameters(given: dict) -> dict:
    """All parameters, the given ones checked against their ranges."""
    given = dict(given)
    if "mobility_prune_min_czi" in given:
        given.setdefault("mobility_prune_min_seed_capture", given.pop("mobility_prune_min_czi"))
    out = {}
    for name, (low, high, default) in PARAMETERS.items():
        value = type(default)(given.get(name, default))
        if not low <= value <= high:
            raise ValueError(f"{name} must lie in {low}..{high}")
        out[name] = value
    return out


@dataclass
class Graph:
    """A bounded neighbourhood: undirected and directed weights, loops, people, centres."""

    near: dict[str, dict[str, float]] = field(default_factory=dict)
    out: dict[str, dict[str, float]] = field(default_factory=dict)
    into: dict[str, dict[str, float]] = field(default_factory=dict)
    loop: dict[str, float] = field(default_factory=dict)
    people: dict[str, int] = field(default_factory=dict)
    at: dict[str, tuple[float, float]] = field(default_factory=dict)

    def add(self, src: str, dst: str, weight: float) -> None:
        if src == dst:
            self.loop[src] = self.loop.get(src, 0.0) + weight
            self.near.setdefault(src, {})
            return
        for a, b in ((src, dst), (dst, src)):
            own = self.near.setdefault(a, {})
            own[b] = own.get(b, 0.0) + weight
        self.out.setdefault(src, {})[dst] = self.out.get(src, {}).get(dst, 0.0) + weight
        self.into.setdefault(dst, {})[src] = self.into.get(dst, {}).get(src, 0.0) + weight

    def population(self, cbg: str) -> int:
        return int(self.people.get(cbg, 0))

    def inside(self, cbg: str, zone: set[str]) -> float:
        return sum(w for n, w in self.near.get(cbg, {}).items() if n in zone)

    def outside(self, cbg: str, zone: set[str]) -> float:
        return sum(w for n, w in self.near.get(cbg, {}).items() if n not in zone and n != cbg)

    def km(self, a: str, b: str) -> float | None:
        if a not in self.at or b not in self.at:
            return None
        (la, oa), (lb, ob) = self.at[a], self.at[b]
        la, oa, lb, ob = map(math.radians, (la, oa, lb, ob))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@dataclass
class Zone:
    cluster: list[str]
    population: int
    trace: list[dict] = field(default_factory=list)
    info: dict = field(default_factory=dict)


Score = Callable[[str, set[str]], "tuple | None"]


def _grow(g: Graph, seed: str, least: int, score: Score, rounds: int, smallest: bool = True, go_on: Callable | None = None) -> Zone:
    """Add the best candidate until the zone has ``least`` people. ``score`` gives a key, of
    which the largest wins, or None; equal keys go to the smallest id, or the largest."""
    zone = Zone([seed], g.population(seed))
    members, frontier = {seed}, set(g.near.get(seed, {}))
    for i in range(rounds):
        if (zone.population >= least) if go_on is None else not go_on(zone, members):
            break
        ranked = [(key, c) for c in sorted(frontier) if (key := score(c, members)) is not None]
        if not ranked:
            break
        top = max(key for key, _ in ranked)
        tied = [c for key, c in ranked if key == top]
        chosen = tied[0] if smallest else tied[-1]
        zone.trace.append({"iteration": i + 1, "before": list(zone.cluster), "selected": chosen, "score": float(top[0]), "candidates": len(ranked)})
        zone.cluster.append(chosen)
        members.add(chosen)
        zone.population += g.population(chosen)
        frontier |= set(g.near.get(chosen, {}))
        frontier -= members
    return zone


def greedy_fast(g: Graph, seed: str, least: int, **_) -> Zone:
    """Most movement shared with the zone, among areas with people."""

    def score(c, zone):
        shared = g.inside(c, zone)
        return (shared,) if g.population(c) and shared > 0 else None

    return _grow(g, seed, least, score, 500)


def greedy_weight(g: Graph, seed: str, least: int, **_) -> Zone:
    """Most movement shared with the zone."""
    return _grow(g, seed, least, lambda c, zone: (g.inside(c, zone),), 1000)


def greedy_ratio(g: Graph, seed: str, least: int, **_) -> Zone:
    """Largest share of the candidate's movement that the zone receives."""

    def score(c, zone):
        a, b = g.inside(c, zone), g.outside(c, zone)
        return (a / (a + b) if a + b else 0.0,)

    return _grow(g, seed, least, score, 1000)


def greedy_ratio_whole(g: Graph, seed: str, least: int, **_) -> Zone:
    """The whole zone's share with the candidate, inner edges counted from both ends."""

    def score(c, zone):
        both = zone | {c}
        inner = sum(g.inside(m, both) for m in both)
        outer = sum(g.outside(m, both) for m in both)
        return (inner / (inner + outer) if inner + outer else 0.0,)

    return _grow(g, seed, least, score, 1000)


def greedy_weight_seed_guard(g: Graph, seed: str, least: int, seed_guard_distance_km: float = 20.0, **_) -> Zone:
    """Most movement shared with the members near the seed; ties to those that would count
    themselves, the nearer, the more populous, the larger id."""
    far: dict[str, float | None] = {}

    def counts(c: str) -> bool:
        if c not in far:
            far[c] = g.km(seed, c)
        return seed_guard_distance_km <= 0 or far[c] is None or far[c] <= seed_guard_distance_km

    def score(c, zone):
        shared = sum(w for n, w in g.near.get(c, {}).items() if n in zone and counts(n))
        ok = counts(c)
        return (shared, ok, -far[c] if far.get(c) is not None else 0.0, g.population(c))

    return _grow(g, seed, least, score, 1000, smallest=False)


def czi_balanced(g: Graph, seed: str, least: int, distance_penalty_weight: float = 0.02, distance_scale_km: float = 20.0, **_) -> Zone:
    """The zone's containment index with the candidate, less a distance penalty."""
    state = {"in": g.loop.get(seed, 0.0), "out": sum(w for w in g.near.get(seed, {}).values() if w > 0), "n": 1}

    def score(c, zone):
        if state["n"] < len(zone):
            state.update(n=len(zone), **_movement(g, zone))
        if g.population(c) <= 0:
            return None
        a, b = g.inside(c, zone), g.outside(c, zone)
        inner = state["in"] + g.loop.get(c, 0.0) + a
        outer = state["out"] - a + b
        outer = 0.0 if -1e-9 < outer < 0 else outer
        czi = inner / (inner + outer) if inner + outer else 0.0
        km = g.km(seed, c)
        fine = km / (km + distance_scale_km) if km is not None else 0.0
        return (czi - distance_penalty_weight * fine, czi, -fine, a)

    return _grow(g, seed, least, score, 501)


def _movement(g: Graph, zone: set[str]) -> dict[str, float]:
    """Movement inside a zone and over its boundary."""
    inner = sum(g.inside(m, zone) for m in sorted(zone)) / 2 + sum(g.loop.get(m, 0.0) for m in sorted(zone))
    return {"in": inner, "out": sum(g.outside(m, zone) for m in sorted(zone))}


def greedy_ttwa(g: Graph, seed: str, least: int, containment_threshold: float = 0.70, **_) -> Zone:
    """Largest gain of the zone's containment by origin and by destination; goes on beyond
    ``least`` people while that grows."""

    def parts(zone):
        inner = sum(g.loop.get(m, 0.0) + sum(w for n, w in g.out.get(m, {}).items() if n in zone) for m in zone)
        out = sum(w for m in zone for n, w in g.out.get(m, {}).items() if n not in zone)
        into = sum(w for m in zone for n, w in g.into.get(m, {}).items() if n not in zone)
        return inner, out, into

    def value(inner, out, into):
        return min(inner / (inner + out) if inner + out else 0.0, inner / (inner + into) if inner + into else 0.0)

    state: dict = {}

    def score(c, zone):
        if state.get("n") != len(zone):
            state.update(n=len(zone), parts=parts(zone))
        inner, out, into = state["parts"]
        to = sum(w for n, w in g.out.get(c, {}).items() if n in zone)
        to_all = sum(g.out.get(c, {}).values())
        by = sum(w for n, w in g.into.get(c, {}).items() if n in zone)
        by_all = sum(g.into.get(c, {}).values())
        after = value(inner + g.loop.get(c, 0.0) + to + by, out - by + to_all - to, into - to + by_all - by)
        return (after - value(inner, out, into),)

    def go_on(zone, members):
        if zone.population < least:
            return True
        near = sorted({n for m in members for n in g.near.get(m, {})} - members)
        return any(score(c, members)[0] > 0 for c in near)

    zone = _grow(g, seed, least, score, 1000, go_on=go_on)
    zone.info["containment"] = value(*parts(set(zone.cluster)))
    zone.info["below_threshold"] = zone.info["containment"] < containment_threshold
    return zone


def mobility_prune(g: Graph, seed: str | list[str], least: int = 0, mobility_prune_min_seed_capture: float = 0.80, multiplier: float = 2.0, floor: int = 100_000, max_areas: int = 250, rounds: int = 1000, **_) -> Zone:
    """Grow an envelope that captures the seeds' movement, then take away what it can spare."""
    asked = list(dict.fromkeys([seed] if isinstance(seed, str) else seed))
    seeds = [s for s in asked if s in g.near]
    if not seeds:
        raise ValueError("no seed is in the graph")
    seed_set, capture_least = set(seeds), mobility_prune_min_seed_capture
    seed_people = sum(map(g.population, seeds))
    target = max(seed_people, math.ceil(seed_people * multiplier), floor)
    inner = sum(g.inside(s, seed_set) for s in seeds) / 2 + sum(g.loop.get(s, 0.0) for s in seeds)
    total = inner + sum(g.outside(s, seed_set) for s in seeds)
    by_seed = lambda c: g.inside(c, seed_set)
    captured, members, people = inner, set(seeds), seed_people
    capture = lambda: captured / total if total else 1.0
    steps, full = 0, False
    while (people < target or capture() < capture_least) and steps < rounds:
        if len(members) >= max_areas:
            full = True
            break
        best = None
        for c in sorted({n for m in members for n in g.near.get(m, {})} - members):
            p, a = g.population(c), g.inside(c, members)
            if p <= 0 or a <= 0:
                continue
            key = (a, a / p, -max(0, people + p - target), -g.outside(c, members), -p)
            if capture() < capture_least:
                key = (by_seed(c), by_seed(c) / p, *key)
            if best is None or key > best[0]:
                best = (key, c)
        if best is None:
            break
        c = best[1]
        captured += by_seed(c)
        members.add(c)
        people += g.population(c)
        steps += 1
    initial, first_people, removed = len(members), people, 0
    moved = _movement(g, members)
    stopped = False
    while removed < rounds:
        best, held_back = None, False
        for c in sorted(members - seed_set):
            p = g.population(c)
            if p <= 0 or not _holds(g, members - {c}, seed_set):
                continue
            lost = by_seed(c)
            if lost > 1e-12 and total and (captured - lost) / total < capture_least:
                held_back = True
                continue
            loss = g.loop.get(c, 0.0) + g.inside(c, members)
            key = (lost / p, lost, loss / p, loss, -p, c)
            if best is None or key < best[0]:
                best = (key, c)
        if best is None:
            stopped = held_back
            break
        c = best[1]
        a, b = g.inside(c, members), g.outside(c, members)
        moved = {"in": max(0.0, moved["in"] - g.loop.get(c, 0.0) - a), "out": max(0.0, moved["out"] - b + a)}
        members.remove(c)
        captured -= by_seed(c)
        people -= g.population(c)
        removed += 1
    info = {"target_population": target, "seed_population": seed_people, "initial_cbgs": initial, "initial_population": first_people, "reduced_population": first_people - people, "removed": removed, "growth_steps": steps, "max_areas_reached": full, "stopped_by_seed_capture_floor": stopped, "seed_capture": capture(), "movement_inside": moved["in"], "movement_boundary": moved["out"], "missing_seeds": [s for s in asked if s not in seed_set], "minimum_population_used": False, "min_pop": least}
    return Zone(sorted(members), people, [], info)


def _holds(g: Graph, zone: set[str], seeds: set[str]) -> bool:
    """Whether seeds reach every member within the zone."""
    seen, todo = set(seeds & zone), list(seeds & zone)
    while todo:
        for n in g.near.get(todo.pop(), {}):
            if n in zone and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen == zone


def czi_optimal_cap(g: Graph, seed: str, least: int, optimal_candidate_limit: int = 120, optimal_population_floor_ratio: float = 0.9, optimal_max_iters: int = 8, optimal_mip_rel_gap: float = 0.02, optimal_time_limit_sec: float = 20, **rest) -> Zone:
    """The connected zone round the seed with the best index and a population between a floor
    and a cap: Dinkelbach's iteration, each subproblem solved by branch and bound to the
    relative gap, or as far as the time limit lets it (``proven`` is then false)."""
    cap = max(least, g.population(seed))
    low = max(g.population(seed), math.floor(cap * optimal_population_floor_ratio))
    pool = _best_first(g, seed, max(10, int(optimal_candidate_limit)))
    people = sum(map(g.population, pool))
    if people <= 0:
        return _fallback(g, seed, least, rest)
    cap, low = min(cap, people), min(low, people)
    program = _Program(g, pool)
    while True:
        found, proven = _dinkelbach(g, program, low, cap, int(optimal_max_iters), optimal_mip_rel_gap, optimal_time_limit_sec)
        if found or low <= g.population(seed):
            break
        low = max(g.population(seed), math.floor(low * 0.9))
    if not found:
        return _fallback(g, seed, least, rest)
    return Zone(sorted(found, key=lambda c: (c != seed, c)), sum(map(g.population, found)), [], {"fallback": False, "czi": _czi(g, found), "population_floor": low, "population_cap": cap, "candidates": len(pool), "proven": proven})


def _fallback(g: Graph, seed: str, least: int, rest: dict) -> Zone:
    zone = czi_balanced(g, seed, least, **rest)
    zone.info["fallback"] = True
    return zone


def _best_first(g: Graph, seed: str, limit: int) -> list[str]:
    chosen = [seed]
    while len(chosen) < limit:
        zone = set(chosen)
        near = sorted({n for m in zone for n in g.near.get(m, {})} - zone)
        if not near:
            break
        chosen.append(max(near, key=lambda c: (g.inside(c, zone), g.loop.get(c, 0.0), len(g.near.get(c, {})), c)))
    return chosen


def _czi(g: Graph, zone: set[str]) -> float:
    m = _movement(g, set(zone))
    return m["in"] / (m["in"] + m["out"]) if m["in"] + m["out"] else 0.0


def _dinkelbach(g: Graph, program: _Program, low: int, cap: int, rounds: int, gap: float, seconds: float) -> tuple[set[str] | None, bool]:
    best: tuple | None = None
    rate, proven = 0.5, True
    for _ in range(rounds):
        zone, done = program.solve(low, cap, rate, gap, seconds, best and best[2])
        proven &= done
        if zone is None:
            break
        czi, people = _czi(g, zone), sum(map(g.population, zone))
        if best is None or czi > best[0] + 1e-9 or (abs(czi - best[0]) <= 1e-9 and people > best[1]):
            best = (czi, people, zone)
        m = _movement(g, zone)
        if abs(czi - rate) <= 1e-4 or abs((1 - rate) * m["in"] - rate * m["out"]) <= 1e-3:
            break
        rate = czi
    return (best[2] if best else None), proven


class _Program:
    """Connected zones of a pool, the seed its first, that maximise
    ``(1 - rate) * inside - rate * boundary`` between two populations.

    With a value for each area and a cost for each pair that a zone parts, the best zone
    without regard to population and connection is a minimum cut. A multiplier on the
    population makes that an upper bound for zones within the limits; branches grow a
    connected zone by one neighbour or ban it.
    """

    def __init__(self, g: Graph, pool: list[str]) -> None:
        self.pool, at = pool, {c: i for i, c in enumerate(pool)}
        self.w = np.zeros((len(pool), len(pool)))
        self.loop = np.array([g.loop.get(c, 0.0) for c in pool])
        self.away = np.zeros(len(pool))
        self.people = np.array([g.population(c) for c in pool], float)
        for c, i in at.items():
            for n, weight in g.near.get(c, {}).items():
                if n in at:
                    self.w[i, at[n]] = weight
                elif n != c:
                    self.away[i] += weight
        np.fill_diagonal(self.w, 0.0)

    def solve(self, low: float, cap: float, rate: float, gap: float, seconds: float, known: set[str] | None = None) -> tuple[set[str] | None, bool]:
        """The best zone, None if no zone fits, and whether it is proven: no zone's value is larger by
        more than ``gap`` times the movement inside, which bounds the index's relative gap.
        ``known`` is a zone that fits, to begin with."""
        self.worth = (1 - rate) * (self.loop + self.w.sum(1) / 2) - rate * self.away
        self.parted = (1 + rate) / 2 * self.w
        n, end = len(self.pool), time.monotonic() + seconds
        best: list = [None, -math.inf]

        def offer(zone: np.ndarray) -> None:
            if low <= self.people[zone].sum() <= cap and (v := self._value(zone)) > best[1] + 1e-12:
                best[:] = [zone.copy(), v]

        first = np.zeros(n, bool)
        first[0] = True
        begun = [z for by in ("person", "index", "inside") if (z := self._fill(first, np.ones(n, bool), low, cap, by)) is not None]
        if known is not None:
            begun.append(np.isin(self.pool, list(known)))
        for zone in begun:
            offer(self._improve(zone, low, cap))
        todo = [(first, np.zeros(n, bool))]
        while todo:
            if best[0] is not None and time.monotonic() > end:
                return self._names(best[0]), False
            zone, banned = todo.pop()
            free = self._reach(zone, ~banned)  # with the zone
            people = self.people[zone].sum()
            if people > cap or self.people[free].sum() < low:
                continue
            offer(zone)
            spare = np.sort(self.people[free & ~zone])[:3]
            if len(spare) < 3 or people + spare.sum() > cap:  # two more at most
                self._pairs(zone, free & ~zone, low, cap, offer)
                continue
            bound, cuts = self._bound(zone, free, low, cap)
            for x in cuts:
                offer(self._reach(zone, x))
            grown = self._fill(zone, free, low, cap, "person")
            if grown is not None and self._value(grown) > best[1]:
                offer(self._improve(grown, low, cap))
            if best[0] is not None and bound - best[1] <= max(1e-12, gap * self._inside(best[0])):
                continue
            near = np.flatnonzero(free & ~zone & (self.w[zone] > 0).any(0))
            near = near[people + self.people[near] <= cap]
            if len(near):
                c = near[np.argmax(self._gains(zone)[near])]
                out, more = banned.copy(), zone.copy()
                out[c] = more[c] = True
                todo += [(zone, out), (more, banned)]
        return (None if best[0] is None else self._names(best[0])), True

    def _names(self, zone: np.ndarray) -> set[str]:
        return {self.pool[i] for i in np.flatnonzero(zone)}

    def _value(self, zone: np.ndarray) -> float:
        return float(self.worth[zone].sum() - self.parted[zone][:, ~zone].sum())

    def _inside(self, zone: np.ndarray) -> float:
        return float(self.loop[zone].sum() + self.w[np.ix_(zone, zone)].sum() / 2)

    def _gains(self, zone: np.ndarray) -> np.ndarray:
        return self.worth + self.parted[zone].sum(0) - self.parted[~zone].sum(0)

    def _reach(self, zone: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        seen = zone.copy()
        while True:
            more = allowed & ~seen & (self.w[seen] > 0).any(0)
            if not more.any():
                return seen
            seen |= more

    def _fill(self, zone: np.ndarray, free: np.ndarray, low: float, cap: float, by: str) -> np.ndarray | None:
        """The best zone that fits of those that this one grows to by the largest gain a person,
        index or movement inside."""
        zone, best, value = zone.copy(), None, -math.inf
        while True:
            if self.people[zone].sum() >= low and (v := self._value(zone)) > value:
                best, value = zone.copy(), v
            near = np.flatnonzero(free & ~zone & (self.w[zone] > 0).any(0))
            near = near[self.people[zone].sum() + self.people[near] <= cap]
            if not len(near):
                return best
            met = self.w[zone].sum(0)
            if by == "index":
                inner = self._inside(zone) + self.loop + met
                both = inner + self.away[zone].sum() + met[~zone].sum() + self.away + self.w.sum(1) - 2 * met
                score = inner / np.maximum(both, 1e-12)
            else:
                score = met if by == "inside" else self._gains(zone) / (1 + self.people)
            zone[near[np.argmax(score[near])]] = True

    def _improve(self, zone: np.ndarray, low: float, cap: float) -> np.ndarray:
        """A zone that no area added, dropped or exchanged makes better (of the 50 best changes)."""
        n = len(zone)
        while True:
            gain, people = self._gains(zone), self.people[zone].sum()
            # rows: the area that goes, columns: the one that comes; the last of each: none
            change = np.full((n + 1, n + 1), -np.inf)
            change[:n, :n] = gain - gain[:, None] - 2 * self.parted
            change[:n, n], change[n, :n] = -gain, gain
            goes, comes = np.append(self.people, 0.0)[:, None], np.append(self.people, 0.0)
            fits = np.outer(np.append(zone, True), np.append(~zone, True)) & (people - goes + comes >= low) & (people - goes + comes <= cap)
            fits[0], fits[n, n] = False, False
            change[~fits] = -np.inf
            for k in np.argsort(change, axis=None)[::-1][:50]:
                i, j = divmod(int(k), n + 1)
                if change[i, j] <= 1e-9:
                    return zone
                new = np.append(zone, False)
                new[i], new[j] = False, True
                new = new[:n]
                first = np.zeros(n, bool)
                first[0] = True
                if (self._reach(first, new) == new).all():
                    zone = new
                    break
            else:
                return zone

    def _pairs(self, zone: np.ndarray, more: np.ndarray, low: float, cap: float, offer: Callable) -> None:
        """Offer the best zone that one or two areas of ``more`` make of this one."""
        some = np.flatnonzero(more)
        if not len(some):
            return
        gain, near = self._gains(zone)[some], (self.w[zone][:, some] > 0).any(0)
        people = self.people[zone].sum() + self.people[some]
        n = len(some)
        change, size = np.full((n, n + 1), -np.inf), np.empty((n, n + 1))
        change[:, :n] = gain + gain[:, None] + 2 * self.parted[np.ix_(some, some)]
        change[:, n], size[:, n] = gain, people
        size[:, :n] = people[:, None] + self.people[some]
        met = np.ones((n, n + 1), bool)
        met[:, :n] = near | (self.w[np.ix_(some, some)] > 0)
        met[np.arange(n), np.arange(n)] = False
        change[~met | ~near[:, None] | (size < low) | (size > cap)] = -np.inf
        i, j = divmod(int(change.argmax()), n + 1)
        if change[i, j] > -np.inf:
            out = zone.copy()
            out[some[i]] = True
            if j < n:
                out[some[j]] = True
            offer(out)

    def _bound(self, zone: np.ndarray, free: np.ndarray, low: float, cap: float) -> tuple[float, list[np.ndarray]]:
        """An upper bound of zones between ``zone`` and ``free``, and the cuts met on the way."""
        x = self._cut(zone, free, 0.0)
        bound, cuts = self._value(x), [x]
        people = self.people[x].sum()
        if low <= people <= cap:
            return bound, cuts
        # the multiplier at which the cut and the zone (or all that is free) are worth the same
        limit, other = (cap, zone) if people > cap else (low, free)
        for _ in range(6):
            step = self.people[x].sum() - self.people[other].sum()
            if abs(step) < 1e-9:
                break
            t = (self._value(x) - self._value(other)) / step
            if t * (people - limit) <= 0:  # the wrong sign bounds nothing
                break
            y = self._cut(zone, free, t)
            cuts.append(y)
            bound = min(bound, self._value(y) - t * (self.people[y].sum() - limit))
            if (self.people[y].sum() > limit) == (people > limit):
                if self.people[y].sum() == self.people[x].sum():
                    break
                x = y
            elif self.people[y].sum() == self.people[other].sum():
                break
            else:
                other = y
        return bound, cuts

    def _cut(self, zone: np.ndarray, free: np.ndarray, t: float) -> np.ndarray:
        """The set between ``zone`` and ``free`` that is worth most, ``t`` a person taken off."""
        some = np.flatnonzero(free & ~zone)
        n = len(some)
        if not n:
            return zone.copy()
        pull = self.worth[some] - t * self.people[some]
        left = np.zeros((n + 2, n + 2))  # what each arc still carries; the source and the sink last
        left[:n, :n] = self.parted[np.ix_(some, some)]
        left[n, :n] = np.maximum(pull, 0) + self.parted[np.ix_(zone, some)].sum(0)
        left[:n, n + 1] = np.maximum(-pull, 0) + self.parted[np.ix_(some, ~free)].sum(1)
        straight = np.minimum(left[n, :n], left[:n, n + 1])
        left[n, :n] -= straight
        left[:n, n + 1] -= straight
        least = 1e-10 * (1 + left.max())
        while True:
            before = np.full(n + 2, -1)
            before[n] = n
            wave = np.array([n])
            while len(wave) and before[n + 1] < 0:
                open_ = left[wave] > least
                new = np.flatnonzero(open_.any(0) & (before < 0))
                before[new] = wave[open_[:, new].argmax(0)]
                wave = new
            if before[n + 1] < 0:
                out = zone.copy()
                out[some[before[:n] >= 0]] = True
                return out
            path = [n + 1]
            while path[-1] != n:
                path.append(before[path[-1]])
            heads, tails = path[:-1], path[1:]
            flow = left[tails, heads].min()
            left[tails, heads] -= flow
            left[heads, tails] += flow


METHODS: dict[str, Callable[..., Zone]] = {f.__name__: f for f in (greedy_fast, greedy_weight, greedy_weight_seed_guard, greedy_ratio, czi_balanced, greedy_ttwa, mobility_prune, czi_optimal_cap, greedy_ratio_whole)}
_RESULT = "run_id string, position int, cbg string, population bigint, zone_population bigint, info string, trace string"


def build(runs: DataFrame, flow: DataFrame, population: DataFrame, centers: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Members ``run_id, position, cbg, population, zone_population, info, trace`` of each of
    ``runs(run_id, algorithm, seed, min_pop, parameters map<string,string>)``.

    ``scope`` names a column that runs and flows share (a state, say): a run then sees the
    flows of its scope alone. Without it every run sees all flows given.
    """
    keys = [scope] if scope else ["_all"]
    if scope is None:
        runs, flow = runs.withColumn("_all", F.lit(1)), flow.withColumn("_all", F.lit(1))
    summed = flow.groupBy(*keys, "src", "dst").agg(F.sum("weight").alias("weight"))
    rows = runs.join(summed, keys).select("run_id", "algorithm", "seed", "min_pop", F.to_json("parameters").alias("parameters"), "src", "dst", "weight")
    ends = rows.select("run_id", "algorithm", "seed", "min_pop", "parameters", F.explode(F.array("src", "dst")).alias("src")).distinct()
    facts = ends.join(population.select(F.col("cbg").alias("src"), "population"), "src", "left")
    if centers is not None:
        facts = facts.join(centers.select(F.col("cbg").alias("src"), "lat", "lon"), "src", "left")
    else:
        facts = facts.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    none = lambda t: F.lit(None).cast(t)
    both = rows.withColumns({"population": none("bigint"), "lat": none("double"), "lon": none("double")}).unionByName(facts.withColumns({"dst": none("string"), "weight": none("double")}))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > NEIGHBOURHOOD_ROWS:
            raise ValueError(f"run {key[0]} has {len(pdf)} rows; give it a smaller scope than {NEIGHBOURHOOD_ROWS}")
        g, head = Graph(), pdf.iloc[0]
        pdf = pdf.sort_values(["src", "dst"], kind="stable")
        for src, dst, weight in pdf.loc[pdf["dst"].notna(), ["src", "dst", "weight"]].itertuples(index=False):
            g.add(src, dst, float(weight))
        for src, people, lat, lon in pdf.loc[pdf["dst"].isna(), ["src", "population", "lat", "lon"]].itertuples(index=False):
            g.people[src] = 0 if pd.isna(people) else int(people)
            if not pd.isna(lat) and not pd.isna(lon):
                g.at[src] = (float(lat), float(lon))
        given = {k: float(v) for k, v in json.loads(head["parameters"] or "{}").items()}
        seed = head["seed"].split(",") if "," in head["seed"] else head["seed"]
        if not isinstance(seed, str) and head["algorithm"] != "mobility_prune":
            seed = seed[0]
        zone = METHODS[head["algorithm"]](g, seed, int(head["min_pop"]), **given)
        n = len(zone.cluster)
        return pd.DataFrame({"run_id": key[0], "position": range(1, n + 1), "cbg": zone.cluster, "population": [g.population(c) for c in zone.cluster], "zone_population": zone.population, "info": json.dumps(zone.info, sort_keys=True), "trace": json.dumps(zone.trace)})

    return both.groupBy("run_id").applyInPandas(run, _RESULT)
