"""Graphlets as integers: catalogs of canonical forms, orbits, sampling weights and their relations.

A graph of k nodes is the number whose bits are the node pairs (k-1, k-2), (k-1, k-3) ... (1, 0), from bit 0 up; a directed one
has a bit for every ordered pair (i, j), by falling i and then falling j. The canonical form of a graph is the least number that a
relabelling gives, and its ordinal is its rank among all canonical forms of k nodes, connected or not.

Everything here is a table of bounded size that depends on k alone. Up to k = 6 whole tables of all numbers are made; beyond,
single numbers are brought to canonical form (:func:`canonicalize`), which Spark does once for each different one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations
from typing import NamedTuple

import numpy as np


def pairs(k: int, directed: bool = False) -> list[tuple[int, int]]:
    """The node pair of each bit."""
    if directed:
        return [(i, j) for i in range(k - 1, -1, -1) for j in range(k - 1, -1, -1) if i != j]
    return [(i, j) for i in range(k - 1, 0, -1) for j in range(i - 1, -1, -1)]


def upper_pairs(k: int) -> list[tuple[int, int]]:
    """The node pair of each bit where the upper triangle is read instead."""
    return [(i, j) for i in range(k - 1, -1, -1) for j in range(k - 1, i, -1)]


@lru_cache(maxsize=None)
def bit_of(k: int, directed: bool = False) -> dict[tuple[int, int], int]:
    out = {p: b for b, p in enumerate(pairs(k, directed))}
    return out if directed else out | {(j, i): b for (i, j), b in out.items()}


def encode(edges: list[tuple[int, int]], k: int, directed: bool = False) -> int:
    bits = bit_of(k, directed)
    return sum(1 << b for b in {bits[e] for e in edges})


def decode(gint: int, k: int, directed: bool = False) -> list[tuple[int, int]]:
    return [p for b, p in enumerate(pairs(k, directed)) if gint >> b & 1]


def neighbours(gint: int, k: int, directed: bool = False) -> list[set[int]]:
    """Neighbours of each node, whatever the edges' direction."""
    out: list[set[int]] = [set() for _ in range(k)]
    for i, j in decode(gint, k, directed):
        out[i].add(j)
        out[j].add(i)
    return out


def is_connected(gint: int, k: int, directed: bool = False) -> bool:
    near = neighbours(gint, k, directed)
    seen, left = {0}, [0]
    while left:
        new = near[left.pop()] - seen
        seen |= new
        left += new
    return len(seen) == k


@lru_cache(maxsize=None)
def _moves(k: int, directed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All permutations of k nodes, by the lexicographic order of their inverses, and for each the bit that every bit
    goes to."""
    perms = np.argsort(np.array(list(permutations(range(k)))), axis=1).astype(np.int8)
    bits = bit_of(k, directed)
    table = np.zeros((k, k), np.int8)
    for (i, j), b in bits.items():
        table[i, j] = b
    one, two = np.array(pairs(k, directed)).T
    return perms, table[perms[:, one], perms[:, two]]


def images(gint: int, k: int, directed: bool = False) -> np.ndarray:
    """The graph under each permutation p of its nodes: node i becomes p[i]."""
    _, moved = _moves(k, directed)
    out = np.zeros(len(moved), np.int64)
    for b in range(moved.shape[1]):
        if gint >> b & 1:
            out |= np.int64(1) << moved[:, b].astype(np.int64)
    return out


def canonicalize(gint: int, k: int, directed: bool = False) -> tuple[int, list[int]]:
    """The canonical form and perm: canonical node j is node perm[j]. Of all such perms it is the one whose inverse comes
    first in lexicographic order."""
    low = int(images(gint, k, directed).min())
    perms, _ = _moves(k, directed)
    first = int(np.flatnonzero(images(low, k, directed) == gint)[0])
    return low, perms[first].tolist()


class Catalog(NamedTuple):
    k: int
    directed: bool
    gints: list[int]  # by ordinal
    connected: list[bool]
    orbits: list[list[int]]  # by ordinal and node

    def edges(self, ordinal: int) -> list[tuple[int, int]]:
        """Edges as (smaller, larger) node, in order; arcs as they are."""
        found = decode(self.gints[ordinal], self.k, self.directed)
        return sorted(found if self.directed else [(min(e), max(e)) for e in found])


def _orbits(gint: int, k: int, directed: bool) -> list[int]:
    """The smallest node that an automorphism takes each node to."""
    perms, _ = _moves(k, directed)
    return perms[images(gint, k, directed) == gint].min(axis=0).tolist()


@lru_cache(maxsize=None)
def canonical_map(k: int, directed: bool = False) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For every number of k nodes its ordinal and perm, and the canonical numbers. Up to k = 6, directed 4."""
    n_bits = len(pairs(k, directed))
    if n_bits > 15:
        raise ValueError(f"whole tables end at 15 node pairs, not {n_bits}")
    perms, _ = _moves(k, directed)
    ordinal = np.full(1 << n_bits, -1, np.int32)
    perm = np.zeros((1 << n_bits, k), np.int8)
    found: list[int] = []
    for gint in range(1 << n_bits):
        if ordinal[gint] >= 0:
            continue
        all_of = images(gint, k, directed)
        other, first = np.unique(all_of, return_index=True)
        ordinal[other] = len(found)
        perm[other] = perms[first]
        found.append(gint)
    return ordinal, perm, found


@lru_cache(maxsize=None)
def canonical_numbers(k: int, directed: bool = False) -> list[int]:
    """All canonical numbers of k nodes, ascending. Beyond whole tables, each graph of k - 1 nodes gets a node more."""
    if len(pairs(k, directed)) <= 15:
        return canonical_map(k, directed)[2]
    if directed:
        raise ValueError("directed catalogs end at 4 nodes")
    found = set()
    for small in canonical_numbers(k - 1):
        old = [(i + 1, j + 1) for i, j in decode(small, k - 1)]
        for near in range(1 << (k - 1)):
            gint = encode(old + [(0, i + 1) for i in range(k - 1) if near >> i & 1], k)
            if gint not in found:
                found.add(int(images(gint, k).min()))
    return sorted(found)


@lru_cache(maxsize=None)
def catalog(k: int, directed: bool = False) -> Catalog:
    gints = canonical_numbers(k, directed)
    orbits, n = [], 0
    for gint in gints:
        least = _orbits(gint, k, directed)
        number = {}
        for node in least:
            if node not in number:
                number[node] = n
                n += 1
        orbits.append([number[node] for node in least])
    return Catalog(k, directed, gints, [is_connected(g, k, directed) for g in gints], orbits)


# ---- sampling weights: in how many ways a method builds a graphlet


def _orders(near: list[set[int]], seen: frozenset[int], by_edge: bool, memo: dict) -> int:
    if len(seen) == len(near):
        return 1
    if seen not in memo:
        total = 0
        for v in range(len(near)):
            links = len(near[v] & seen) if v not in seen else 0
            if links:
                total += (links if by_edge else 1) * _orders(near, seen | {v}, by_edge, memo)
        memo[seen] = total
    return memo[seen]


def _walks(near: list[set[int]], seen: frozenset[int], u: int, v: int) -> int:
    """Walks over edges that swap one end of (u, v) for an unseen neighbour of the other until all are seen."""
    if len(seen) == len(near):
        return 1
    return sum(_walks(near, seen | {w}, u, w) for w in near[u] - seen) + sum(
        _walks(near, seen | {w}, w, v) for w in near[v] - seen
    )


@lru_cache(maxsize=None)
def alphas(k: int, method: str) -> list[int]:
    """By ordinal: 0 if disconnected, else the ways in which NBE, EBE or MCMC builds the graphlet."""
    out = []
    for gint in canonical_numbers(k):
        near, total = neighbours(gint, k), 0
        if is_connected(gint, k):
            memo: dict = {}
            for u, v in combinations(range(k), 2):
                if v in near[u]:
                    start = frozenset((u, v))
                    total += _walks(near, start, u, v) if method == "MCMC" else _orders(near, start, method == "EBE", memo)
        out.append(total // 2 if method == "MCMC" else total)
    return out


# ---- relations between catalogs


def ordinal_of(gint: int, k: int, directed: bool = False) -> int:
    if len(pairs(k, directed)) <= 15:
        return int(canonical_map(k, directed)[0][gint])
    return canonical_numbers(k).index(canonicalize(gint, k)[0])


def without(gint: int, k: int, node: int) -> int:
    """The graph that is left when a node goes."""
    keep = [i for i in range(k) if i != node]
    at = {v: i for i, v in enumerate(keep)}
    return encode([(at[i], at[j]) for i, j in decode(gint, k) if node not in (i, j)], k - 1)


@lru_cache(maxsize=None)
def subcanonicals(k: int) -> list[list[int]]:
    """By ordinal and removed node, the last node first: the ordinal among graphs of k - 1 nodes."""
    rank = {g: i for i, g in enumerate(canonical_numbers(k - 1))}
    if len(pairs(k - 1)) <= 15:
        table = canonical_map(k - 1)[0]
        return [[int(table[without(g, k, v)]) for v in reversed(range(k))] for g in canonical_numbers(k)]
    return [[rank[canonicalize(without(g, k, v), k - 1)[0]] for v in reversed(range(k))] for g in canonical_numbers(k)]


@lru_cache(maxsize=None)
def hamming(k: int) -> np.ndarray:
    """Least number of edges to flip from one ordinal's graphs to another's."""
    ordinal, _, found = canonical_map(k)
    every = np.arange(len(ordinal))
    out = np.full((len(found), len(found)), 99, np.int64)
    for i, gint in enumerate(found):
        np.minimum.at(out[i], ordinal, np.bitwise_count(every ^ gint).astype(np.int64))
    return out


def minimal_chain(k: int, ordinal: int) -> list[tuple[int, int]]:
    """(k, ordinal) down to 3 nodes, each the smallest ordinal that removing a node gives, connected ones first."""
    out = [(k, ordinal)]
    while k > 3:
        below = catalog(k - 1)
        ordinal = min(subcanonicals(k)[ordinal], key=lambda o: (not below.connected[o], o))
        k -= 1
        out.append((k, ordinal))
    return out


def is_bridge(gint: int, k: int, edge: tuple[int, int]) -> bool:
    return is_connected(gint, k) and not is_connected(gint & ~(1 << bit_of(k)[edge]), k)


def to_upper(gint: int, k: int) -> int:
    """The number that the same matrix has when its upper triangle is read."""
    bits = {p: b for b, p in enumerate(upper_pairs(k))}
    return sum(1 << bits[(j, i)] for i, j in decode(gint, k))


@lru_cache(maxsize=None)
def crosswalk(k: int) -> list[dict[str, int]]:
    """A row per graph of k nodes with its names in the lower and the upper numbering, and its first orbits in both."""
    low = catalog(k)
    upper = {}
    for o, gint in enumerate(low.gints):
        upper[o] = min(to_upper(int(g), k) for g in np.unique(images(gint, k)))
    order = sorted(upper, key=upper.get)
    sizes = [len(set(o)) for o in low.orbits]
    rows = []
    for o, gint in enumerate(low.gints):
        rank = order.index(o)
        before = lambda seq, only: sum(sizes[x] for x in seq if not only or low.connected[x])
        rows.append(
            {
                "connected": int(low.connected[o]),
                "upper_ordinal": rank,
                "upper_decimal": upper[o],
                "lower_decimal": gint,
                "lower_ordinal": o,
                "num_orbits": sizes[o],
                "first_orbit_nodes": low.orbits[o].count(low.orbits[o][0]),
                "first_orbit_connected": before(range(o), True) if low.connected[o] else 0,
                "first_orbit_all": before(range(o), False),
                "first_orbit_connected_upper": before(order[:rank], True) if low.connected[o] else 0,
                "first_orbit_all_upper": before(order[:rank], False),
            }
        )
    return rows


# ---- prediction: node pairs of a graphlet that an edge would turn into a given orbit pair


@lru_cache(maxsize=None)
def pair_motifs(k: int, orbit_a: int, orbit_b: int, by_order: bool = True) -> dict[tuple[int, int, int], int]:
    """(ordinal, i, j), i < j not adjacent: how often the pair has the two orbits in a connected spanning subgraph. With
    by_order a subgraph that lacks r edges counts once for every order in which they can go while all stays connected."""
    whole = catalog(k)
    wanted = tuple(sorted((orbit_a, orbit_b)))
    owner = {o for o, orbits in enumerate(whole.orbits) if orbit_a in orbits and orbit_b in orbits}
    if not owner:
        raise ValueError(f"orbits {orbit_a} and {orbit_b} belong to no common graphlet of {k} nodes")
    out: dict[tuple[int, int, int], int] = {}
    for o, gint in enumerate(whole.gints):
        if not whole.connected[o]:
            continue
        # levels of the lattice of connected spanning subgraphs, with the number of ways down to each
        level = {gint: 1}
        while level:
            below: dict[int, int] = {}
            for sub, ways in level.items():
                low, perm = _canonical(sub, k)
                if low in owner:
                    orbits = [0] * k
                    for j, node in enumerate(perm):
                        orbits[node] = whole.orbits[low][j]
                    for i, j in combinations(range(k), 2):
                        if not gint >> bit_of(k)[(i, j)] & 1 and tuple(sorted((orbits[i], orbits[j]))) == wanted:
                            out[(o, i, j)] = out.get((o, i, j), 0) + (ways if by_order else 1)
                for b in range(len(pairs(k))):
                    if sub >> b & 1 and is_connected(sub ^ (1 << b), k):
                        below[sub ^ (1 << b)] = below.get(sub ^ (1 << b), 0) + ways
            level = below
    return out


def _canonical(gint: int, k: int) -> tuple[int, list[int]]:
    ordinal, perm, _ = canonical_map(k)
    return int(ordinal[gint]), perm[gint].tolist()


# ---- closed numbering of degree vectors


# For each column of the usual orbit order of 4 and 5 nodes, the place of its orbit among connected ones.
ORCA_ORBITS = {
    4: [2, 3, 0, 1, 7, 4, 5, 6, 8, 9, 10],
    5: [
        9, 11, 10, 3, 2, 4, 5, 0, 1, 12, 13, 14, 27, 30, 28, 29, 6, 7, 8, 40, 15, 17, 16, 18, 19, 20, 21, 22, 38, 39, 31, 32, 34,
        33, 23, 24, 42, 41, 43, 25, 26, 35, 36, 37, 44, 45, 46, 47, 49, 48, 50, 51, 52, 53, 54, 55, 56, 57,
    ],
}


def connected_orbits(k: int) -> list[int]:
    """Orbits of connected graphlets in order; a connected orbit's number is its place here."""
    whole = catalog(k)
    return sorted({x for o, orbits in enumerate(whole.orbits) if whole.connected[o] for x in orbits})
