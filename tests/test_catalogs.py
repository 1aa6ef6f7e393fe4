import random
from itertools import combinations

import numpy as np
import pytest

from motiflake.functions import graphlets as g
from motiflake.functions import numbers as num
from motiflake.plans import catalogs


@pytest.mark.parametrize("k,graphs,orbits", [(3, 4, 6), (4, 11, 20), (5, 34, 90), (6, 156, 544)])
def test_sizes(k, graphs, orbits):
    whole = g.catalog(k)
    assert len(whole.gints) == graphs
    assert max(x for o in whole.orbits for x in o) + 1 == orbits


def test_seven_nodes():
    assert len(g.canonical_numbers(7)) == 1044


def test_directed_sizes():
    assert len(g.catalog(3, True).gints) == 16 and len(g.catalog(4, True).gints) == 218


def test_known_lists():
    four = g.catalog(4)
    assert four.gints[:5] == [0, 1, 3, 7, 11]
    assert four.orbits[:5] == [[0, 0, 0, 0], [1, 1, 2, 2], [3, 4, 4, 5], [6, 6, 6, 7], [8, 9, 9, 9]]
    assert [o for o, c in enumerate(four.connected) if c] == [3, 6, 7, 8, 9, 10]


@pytest.mark.parametrize(
    "k,method,want",
    [
        (3, "NBE", {2: 2, 3: 3}), (3, "EBE", {2: 2, 3: 6}), (3, "MCMC", {2: 1, 3: 3}),
        (4, "NBE", {3: 6, 6: 4, 7: 7, 8: 8, 9: 10, 10: 12}), (4, "EBE", {3: 6, 6: 4, 7: 14, 8: 16, 9: 36, 10: 72}),
        (4, "MCMC", {3: 3, 6: 1, 7: 5, 8: 4, 9: 12, 10: 24}),
    ],
)
def test_alphas(k, method, want):
    assert {o: a for o, a in enumerate(g.alphas(k, method)) if a} == want


def test_canonical_map():
    ordinal, perm, found = g.canonical_map(4)
    rng = random.Random(1)
    for gint in rng.sample(range(64), 40):
        low = found[ordinal[gint]]
        edges = {frozenset(e) for e in g.decode(low, 4)}
        p = perm[gint]
        assert {frozenset((int(p[i]), int(p[j]))) for i, j in g.decode(low, 4)} == {frozenset(e) for e in g.decode(gint, 4)}
        assert low == min(g.images(gint, 4))
        assert len(edges) == bin(gint).count("1")
    assert perm[1].tolist() == [0, 1, 2, 3] and found[ordinal[0b100101]] == 13 and perm[37].tolist() == [2, 1, 0, 3]


@pytest.mark.parametrize("k", [5, 7, 8])
def test_canonical_form_is_free_of_labels(k):
    rng = random.Random(k)
    for _ in range(4):
        gint = rng.getrandbits(len(g.pairs(k)))
        images = g.images(gint, k)
        low, perm = g.canonicalize(gint, k)
        other, _ = g.canonicalize(int(images[rng.randrange(len(images))]), k)
        assert low == other == int(images.min())
        moved = g.encode([(perm[i], perm[j]) for i, j in g.decode(low, k)], k)
        assert moved == gint


def test_subcanonicals_and_hamming():
    assert g.subcanonicals(4)[3] == [0, 2, 2, 2] and g.subcanonicals(4)[4] == [1, 1, 1, 3]
    h = g.hamming(4)
    assert np.array_equal(h, h.T) and (np.diag(h) == 0).all() and h[0, 10] == 6
    assert g.minimal_chain(5, 33)[-1][0] == 3


def test_orca_order_is_a_permutation():
    for k in (4, 5):
        assert sorted(g.ORCA_ORBITS[k]) == list(range(len(g.connected_orbits(k))))


def test_crosswalk():
    rows = g.crosswalk(4)
    assert sorted(r["upper_ordinal"] for r in rows) == list(range(11))
    assert rows[10]["upper_decimal"] == rows[10]["lower_decimal"] == 63


def test_pair_motifs_by_brute_force():
    """Connected spanning subgraphs in which a missing pair takes both orbits, one by one."""
    ordinal, perm, _ = g.canonical_map(4)
    whole = g.catalog(4)
    want: dict = {}
    for o, gint in enumerate(whole.gints):
        if not whole.connected[o]:
            continue
        bits = [b for b in range(6) if gint >> b & 1]
        for r in range(len(bits) + 1):
            for gone in combinations(bits, r):
                sub = gint
                for b in gone:
                    sub ^= 1 << b
                if not g.is_connected(sub, 4):
                    continue
                orbit = {int(perm[sub][j]): whole.orbits[ordinal[sub]][j] for j in range(4)}
                for i, j in combinations(range(4), 2):
                    if not gint >> g.bit_of(4)[(i, j)] & 1 and sorted((orbit[i], orbit[j])) == [11, 11]:
                        want[(o, i, j)] = want.get((o, i, j), 0) + 1
    assert g.pair_motifs(4, 11, 11, by_order=False) == want
    with pytest.raises(ValueError):
        g.pair_motifs(4, 11, 19)


def test_tables(spark):
    assert catalogs.canon(spark, 5).count() == 34
    assert catalogs.canon_map(spark, 5).count() == 1024
    assert catalogs.orbits(spark, 4).filter("connected_orbit is not null").select("orbit").distinct().count() == 11
    assert catalogs.hamming(spark, 4).filter("c1 = 0").agg({"dist": "max"}).first()[0] == 6
    assert {r["k"]: r["canonicals"] for r in catalogs.directed_totals(spark).collect()} == {3: 16, 4: 218}


def test_numbers():
    assert num.t_quantile(0.95, 10) == pytest.approx(2.228139, abs=1e-5)
    assert num.t_quantile(0.95, 10**6) == pytest.approx(1.959966, abs=1e-4)
    assert num.hypergeometric_tail(10, 5, 5, 0) == 1 and num.hypergeometric_tail(10, 5, 5, 5) == pytest.approx(1 / 252)
    assert num.ks_tail(0) == 1 and num.ks_tail(1.36) == pytest.approx(0.0494, abs=1e-3)
    assert sum(num.poisson(3.0, n) for n in range(60)) == pytest.approx(1)
    assert num.f1(0.5, 0.5) == 0.5 and num.f1(0, 0) == 0 and num.binomial(5, 7) == 0
