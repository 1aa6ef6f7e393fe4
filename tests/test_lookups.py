"""Searches over graphs that are not gathered give what they give on whole ones."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiflake.operators import aggregate as ag
from motiflake.operators import enumerate as en
from motiflake.operators import fast_sampling as fs
from motiflake.operators import graph_loops as gl
from motiflake.operators import index as ix
from motiflake.operators import local as lo
from motiflake.operators import lookups
from motiflake.operators import measures as ms
from motiflake.operators import normalize as nm
from motiflake.operators import sampling as sp
from motiflake.operators import spans
from motiflake.queries import queries
from motiflake.sources import graphs


def drawn(n, m, seed):
    return sorted(random.Random(seed).sample(list(combinations(range(n), 2)), m))


@pytest.fixture(scope="module")
def two(spark):
    rows = drawn(60, 130, 2)
    return [spark.createDataFrame(x, "src long, dst long") for x in (rows[::-1][8:], rows)]


@pytest.fixture(scope="module")
def seeds(spark):
    rows = [(f"s{i}", [u, v, 99], [u, v, 99]) for i, (u, v) in enumerate(drawn(60, 130, 2)[:9])]
    return spark.createDataFrame(rows, "key string, nodes1 array<bigint>, nodes2 array<bigint>")


def both(monkeypatch, make):
    """Rows of a search where graphs are broadcast, and where they are over every bound."""
    whole = sorted(map(str, make().collect()))
    monkeypatch.setattr(lookups, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(lo, "MOST_EDGES", 3)
    assert whole and sorted(map(str, make().collect())) == whole


def test_grown_alignments_of_any_graph(two, seeds, monkeypatch):
    both(monkeypatch, lambda: lo.align(*two, seeds, least_ec=0.5, most=12))


def test_merged_alignments_of_any_graph(two, seeds, monkeypatch):
    both(monkeypatch, lambda: lo.merge_with_floor(*two, lo.align_all(*two, seeds, least_ec=0.7, most=2, size=8).cache(), 0.3))


@pytest.fixture(scope="module")
def mixed(spark):
    """Cliques in a ring and edges by chance among them, with the neighbours by triangles."""
    extra = spark.createDataFrame(drawn(60, 90, 5), "src long, dst long")
    edges = nm.clean(nm.clique_communities(spark, 10, 6, 2).union(extra)).cache()
    return edges, ag.communities(en.connected_sets(edges, 3), 3, by_orbit=False, symmetric=True).cache()


def plain_choice(rows, overlap):
    """Node sets in their order, each that shares no more than the overlap of its nodes with one taken before."""
    taken = []
    for nodes in rows:
        if all(len(nodes & t) <= overlap * len(nodes) for t in taken):
            taken.append(nodes)
    return taken


def test_clusters_of_any_graph(mixed, monkeypatch):
    edges, own = mixed
    near = {r["id"]: set(r["nbrs"]) for r in nm.adjacency(edges).collect()}
    reach = lookups.Near()
    for r in own.collect():
        reach[r["node"]] = set(reach[r["node"]]) | set(r["neighbours"])
    grown = {frozenset(lo.grow_cluster(v, near, reach, 0.6)) for v in near}
    inside = lambda c: sum(len(near[v] & c) for v in c) // 2
    order = sorted((c for c in grown if len(c) >= 3), key=lambda c: (-len(c), -inside(c), sorted(c)))
    want = plain_choice(order, 0.5)
    assert 1 < len(want) < len(order)
    for few in (50_000, 0):
        monkeypatch.setattr(lo, "FEW_RIVALS", few)
        rows = sorted(lo.clusters(edges, own, 0.6).collect())
        assert [(r["cluster"], r["n"], r["m"], r["nodes"]) for r in rows] == [(i, len(c), inside(c), sorted(c)) for i, c in enumerate(want)]
        monkeypatch.setattr(lookups, "BROADCAST_EDGES", 0)
        monkeypatch.setattr(lo, "MOST_EDGES", 3)


@pytest.mark.parametrize("few", [50_000, 0])
def test_selected_clusters_of_any_number(spark, monkeypatch, few):
    rng = random.Random(7)
    rows = [(100 - i, sorted(rng.sample(range(40), rng.randint(3, 8))), rng.randint(3, 20)) for i in range(60)]
    found = [(c, len(v), m, m / 30, v) for c, v, m in rows]
    frame = spark.createDataFrame(found, "cluster long, n long, m long, density double, nodes array<bigint>")
    order = sorted((x for x in found if x[2] * x[3] >= 1.0), key=lambda x: (-x[2] * x[3], x[0]))
    want = plain_choice([frozenset(x[4]) for x in order], 0.2)
    monkeypatch.setattr(lo, "FEW_RIVALS", few)
    monkeypatch.setattr(lo, "MOST_EDGES", 3)
    got = sorted(lo.select_clusters(frame, 0.2, 1.0).collect(), key=lambda r: r["place"])
    by = {x[0]: x for x in found}
    assert [frozenset(by[r["cluster"]][4]) for r in got] == want and [r["place"] for r in got] == list(range(len(want)))
    assert all(r["score"] == by[r["cluster"]][2] * by[r["cluster"]][3] for r in got)


def test_communities_of_triples_by_closed_forms(mixed):
    edges, own = mixed
    got = ms.triple_communities(edges)
    assert got.dtypes == own.dtypes and sorted(map(str, got.collect())) == sorted(map(str, own.collect()))


def test_selected_clusters_list_no_paths(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    edges = graphs.gadj(spark, sf).cache()
    own = ag.communities(en.connected_sets(edges, 3), 3, by_orbit=False, symmetric=True)
    want = sorted(map(str, lo.select_clusters(lo.clusters(edges, own, 0.7), 0.2, 1.0, "EDN").collect()))
    tried = []
    real = lookups.stash
    monkeypatch.setattr(lookups, "stash", lambda x: tried.append("wanted" in x.columns) or real(x))
    monkeypatch.setattr(lookups, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(en, "connected_sets", None)
    assert want and sorted(map(str, queries()["selected_clusters"](spark, sf).collect())) == want
    assert sum(tried) < 10  # rounds


def test_pairs_of_a_large_key_are_dealt_out(spark):
    names = lambda n, c: spark.range(n).select(F.concat_ws("_", F.lit(c), "id", F.col("id") % 2).alias("name"))
    pairs = nm.ortholog_pairs(names(400, "a"), names(30, "b"), lambda c: F.upper(c))
    assert sorted(map(tuple, pairs.collect())) == sorted((f"A_{i}_{i % 2}", f"B_{j}_{j % 2}") for i in range(400) for j in range(30) if i % 2 == j % 2)
    held = pairs.groupBy(F.spark_partition_id()).count()
    assert held.agg(F.max("count")).first()[0] < 6000 / 4


@pytest.fixture
def path(spark, monkeypatch):
    """A long path, whose edges must not be gathered."""

    def gathered(edges):
        raise AssertionError("edges on the driver")

    monkeypatch.setattr(fs, "lists", gathered)
    return spark.range(600_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def test_samples_of_many_edges_gather_nothing(path):
    rows = fs.grow(path, 3, 200, "EBE").collect()
    assert len(rows) == 200 and all(max(r["nodes"]) - min(r["nodes"]) == 2 for r in rows)


def test_precision_of_many_edges_gathers_nothing(path):
    told, taken = sp.until_precise(path, 3, "EBE", 50, 0.5, most=5)
    assert taken == 3 and max(r["mean"] for r in told.collect()) == 50


@pytest.mark.parametrize("most", [500_000, 0])
def test_batches_prepare_the_graph_once(spark, monkeypatch, most):
    edges = spark.createDataFrame(drawn(40, 120, 3), "src long, dst long")
    monkeypatch.setattr(fs, "MOST_EDGES", most)
    wants = [sorted(map(str, fs.grow(edges, 3, 300, "EBE", 1000 + b).collect())) for b in range(3)]
    name = "numbered" if most == 0 else "lists"
    seen, real = [], getattr(fs, name)
    monkeypatch.setattr(fs, name, lambda *x: seen.append(x) or real(*x))
    draw = fs.sampler(edges, 3, "EBE", often=True)
    assert [sorted(map(str, draw(300, 1000 + b).collect())) for b in range(3)] == wants
    _, taken = sp.until_precise(edges, 3, "EBE", 300, 0.0, most=4)
    assert taken == 4 and len(seen) == 2


def test_lists_are_gathered_as_columns(spark, monkeypatch):
    edges = spark.createDataFrame(drawn(40, 120, 3), "src long, dst long")
    want = fs.arrays(edges.toPandas().to_numpy())

    def rows(*x):
        raise AssertionError("rows one by one")

    for name in ("toPandas", "collect", "toLocalIterator"):
        monkeypatch.setattr(type(edges), name, rows)
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(fs.lists(edges), want))


def test_orbit_degrees_of_many_edges_gather_nothing(path):
    rows = sp.sampled_orbit_degrees(fs.grow(path, 3, 100, "NBE"), 3, "NBE").collect()
    assert len({r["orbit"] for r in rows}) == 2 and len(rows) > 100


@pytest.mark.parametrize("target", [0.0, 30.0])
def test_rewiring_of_any_graph(spark, monkeypatch, target):
    edges = spark.createDataFrame(drawn(40, 120, 3), "src long, dst long")
    whole = lambda near: lo.triangle_measure(near)  # noqa: E731  # a measure of the whole graph
    want = sorted(map(tuple, lo.rewire(edges, {"triangles": target}, whole, 200, 4).collect()))
    assert want != drawn(40, 120, 3)
    monkeypatch.setattr(lo, "MOST_EDGES", 3)
    assert sorted(map(tuple, lo.rewire(edges, {"triangles": target}, lo.triangle_measure, 200, 4).collect())) == want


def test_rewiring_towards_any_graph(spark, monkeypatch):
    a, b = (spark.createDataFrame(drawn(30, 80, s), "src long, dst long") for s in (1, 2))
    goal = lo._profile(lo.neighbours(lo.gather(b)))
    unit = lo.objectives(lo._profile(lo.neighbours(lo.gather(a))), goal)

    def whole(near):
        now = lo.objectives(lo._profile(near), goal)
        return {"distance": sum(now[x] / (unit[x] or 1.0) for x in lo.OBJECTIVES)}

    want = sorted(map(tuple, lo.rewire(a, {"distance": 0.0}, whole, 80, 3).collect()))
    assert want != drawn(30, 80, 1)
    monkeypatch.setattr(lo, "MOST_EDGES", 3)
    assert sorted(map(tuple, lo.rewire_towards(a, b, dict.fromkeys(lo.OBJECTIVES, 1.0), 80, 3).collect())) == want


def test_rewiring_towards_lists_triangles_once_a_graph(spark, monkeypatch):
    a, b = (spark.createDataFrame(drawn(30, 80, s), "src long, dst long") for s in (1, 2))
    seen, real = [], ms.clustering
    monkeypatch.setattr(ms, "clustering", lambda x: seen.append(x.inputFiles()) or real(x))
    assert lo.rewire_towards(a, b, dict.fromkeys(lo.OBJECTIVES, 1.0), 80, 3).count() == 80
    assert len(seen) == 2 and all("/loop-" in f for files in seen for f in files)


def test_stamping_of_any_graph(spark, monkeypatch):
    monkeypatch.setattr(lo, "MOST_EDGES", 3)
    rows = drawn(40, 120, 3)
    edges, links = spark.createDataFrame(rows, "src long, dst long"), set(rows)
    found = lo.pieces(edges, 5, 0, 30, 2)
    assert [p["piece"] for p in found] == list(range(30)) and len({tuple(p["nodes"]) for p in found}) > 20
    for p in found:
        for i, v in enumerate(p["nodes"]):
            assert p["near"][i] == {b if a == v else a for a, b in links if v in (a, b)}
            assert i == 0 or any((min(u, v), max(u, v)) in links for u in p["nodes"][:i])
    made = [tuple(r) for r in lo.stamped(spark, edges, 25, 70, 5, 2).collect()]
    assert len(set(made)) == len(made) == 70 and all(0 <= a < b < 25 for a, b in made)
    assert made == [tuple(r) for r in lo.stamped(spark, edges, 25, 70, 5, 2).collect()]
    assert lo.stamped(spark, edges.limit(0), 25, 70, 5).count() == 0


def test_partitions_of_any_graph(spark, mixed, monkeypatch):
    edges, _ = mixed
    near = lo.neighbours(lo.gather(edges))
    monkeypatch.setattr(lo, "MOST_EDGES", 3)

    def parts(steps, **more):
        out: dict = {}
        for r in lo.optimise_partition(edges, 7, steps, **more).collect():
            out.setdefault(r["community"], set()).add(r["node"])
        assert sorted(v for p in out.values() for v in p) == sorted(near)
        assert [min(out[c]) for c in range(len(out))] == sorted(map(min, out.values()))
        return out

    start = lo.breadth_first_parts(near, 7)
    assert parts(0) == start
    assert lo.partition_score(near, parts(1500)) > lo.partition_score(near, start)
    parts(300, heat=2.0)
    assert lo.optimise_partition(edges.limit(0), 7, 10).count() == 0


def test_partition_leaves_no_step_that_gains(spark, mixed):
    edges = mixed[0].union(spark.createDataFrame([(u + 1000, v + 1000) for u, v in drawn(40, 90, 3)] + [(2000, 2001)], "src long, dst long"))
    near = lo.neighbours(lo.gather(edges))
    parts: dict = {}
    for r in lo.optimise_partition(edges, 7).collect():
        parts.setdefault(r["community"], set()).add(r["node"])
    assert sorted(v for p in parts.values() for v in p) == sorted(near)
    assert [min(parts[c]) for c in range(len(parts))] == sorted(map(min, parts.values()))
    home = {v: c for c, p in parts.items() for v in p}
    worth = lambda *sets: lo.partition_score(near, dict(enumerate(sets)))
    for v, a in home.items():
        own = parts[a]
        half = own & {v, *near[v]}
        assert worth(half, own - half) <= worth(own) + 1e-6
        for b in {home[u] for u in near[v]} - {a}:
            assert worth(own - {v}, parts[b] | {v}) <= worth(own, parts[b]) + 1e-6
            assert worth(own | parts[b]) <= worth(own, parts[b]) + 1e-6


def test_partition_query_works_on_the_whole_graph(spark):
    sf = "/root/testdata/sf0.001"
    edges = graphs.g12(spark, sf)
    near, parts = lo.neighbours(lo.gather(edges)), {}
    for r in queries()["optimised_partition"](spark, sf).collect():
        parts.setdefault(r["community"], set()).add(r["node"])
    assert sorted(v for p in parts.values() for v in p) == sorted(near)
    home = {v: c for c, p in parts.items() for v in p}
    worth = lambda *sets: lo.partition_score(near, dict(enumerate(sets)))
    for v, a in home.items():
        for b in {home[u] for u in near[v]} - {a}:
            assert worth(parts[a] - {v}, parts[b] | {v}) <= worth(parts[a], parts[b]) + 1e-6


def test_hops_in_arrays_and_by_joins(spark, monkeypatch):
    parts = [[(u + 100 * i, v + 100 * i) for u, v in drawn(20 + i, 28, i)] for i in range(4)] + [[(i, i + 1) for i in range(500, 570)], [(900 + 2 * i, 901 + 2 * i) for i in range(30)]]
    edges = spark.createDataFrame([e for p in parts for e in p], "src long, dst long")
    none = lambda *x: None
    some = nm.nodes(edges).filter("id % 3 = 0")
    for most, of in ((None, None), (3, None), (None, some)):
        monkeypatch.setattr(gl, "_hops_by_joins", none)
        monkeypatch.setattr(gl, "ARRAY_EDGES", 10_000)
        got = sorted(map(tuple, gl.hop_distribution(edges, most, of).collect()))
        monkeypatch.undo()
        assert got == sorted(map(tuple, gl._hops_by_joins(edges, most, of, 4096).collect())) and len(got) == (most or 70)
    own = spans.spanned(edges)
    for width in (1, 7, 10_000):
        assert [s for b in own.batches(width) for s in range(*b[2:])] == list(range(len(own.ids)))


@pytest.mark.parametrize("n, m", [(30, 45), (200, 260)])
def test_hops_over_lists_of_nth_neighbours(n, m):
    near = lo.neighbours(drawn(n, m, 8))
    ids = sorted(near)
    at = np.concatenate([[0], np.cumsum([len(near[v]) for v in ids])])
    flat = np.array([ids.index(u) for v in ids for u in sorted(near[v])])
    own = spans.slots(at, flat)
    assert sum(map(len, own.lists)) == 2 * m and all(len(x) >= len(y) for x, y in zip(own.lists, own.lists[1:]))
    sources = np.arange(0, len(ids), 2)
    want: list = []
    for s in sources:
        seen, front = {ids[s]}, {ids[s]}
        for hop in range(n):
            front = set().union(*(near[v] for v in front)) - seen
            if not front:
                break
            seen |= front
            want += [0] * (hop + 1 - len(want))
            want[hop] += len(front)
    assert spans.hops(own, sources, None) == want and spans.hops(own, sources, 2) == want[:2]


def test_measures_of_many_components(spark, monkeypatch):
    rows = [(u + 100 * i, v + 100 * i) for i in range(6) for u, v in drawn(25, 40, 1)]
    one, six = (spark.createDataFrame(x, "src long, dst long") for x in (rows[:40], rows + [(900 + 2 * i, 901 + 2 * i) for i in range(40)]))
    monkeypatch.setattr(lo, "MOST_EDGES", 3)
    a, b = (lo.global_measures(x, width).first() for x, width in ((one, 256), (six, 5)))
    assert (b["n"], b["m"], b["components"]) == (6 * a["n"] + 80, 280, 6 * a["components"] + 40)
    for c in ("diameter", "node_betweenness", "edge_betweenness", "eigenvalue"):
        assert b[c] == pytest.approx(a[c], abs=1e-5), c
    # a search reads its component alone
    own = spans.spanned(six)
    assert max(hi - lo for lo, hi, *_ in own.batches(5)) <= 25


def test_paths_by_depth_are_those_from_each_node():
    near = lo.neighbours(drawn(60, 90, 9) + [(200 + i, 201 + i) for i in range(9)])
    ids = sorted(near)
    at = np.concatenate([[0], np.cumsum([len(near[v]) for v in ids])])
    flat = np.array([ids.index(u) for v in ids for u in sorted(near[v])])
    owner = np.repeat(np.arange(len(ids)), np.diff(at))
    once = owner < flat
    sources = np.arange(len(ids))
    told, none = spans.depths(spans.slots(at, flat), sources)
    assert spans.depths(spans.slots(at, flat), sources, 3) is None
    for s in sources:
        deep, by_node, by_arc = lo._paths_from(s, at, flat, owner)
        got = lo._paths_by_depth(told[s], none, owner[once], flat[once])
        assert got[0] == deep and told[s].max() <= none
        nodes, edges = np.zeros(len(ids)), np.zeros(once.sum())
        nodes[got[1]], edges[got[3]] = got[2], got[4]
        whole = {}
        for u, v, x in zip(owner, flat, by_arc):
            whole[min(u, v), max(u, v)] = whole.get((min(u, v), max(u, v)), 0) + x
        assert nodes == pytest.approx(by_node) and edges == pytest.approx([whole[e] for e in zip(owner[once], flat[once])])


def test_measures_of_a_deep_graph(spark):
    # deeper than what is searched by depths of all nodes
    row = lo.global_measures(spark.createDataFrame([(i, i + 1) for i in range(150)], "src long, dst long"), 70).first()
    assert row["diameter"] == 150 and row["node_betweenness"] == 75 * 75 and row["edge_betweenness"] == 75 * 76


def test_all_alignments_of_any_graph(two, seeds, monkeypatch):
    both(monkeypatch, lambda: lo.align_all(*two, seeds, least_ec=0.7, most=3, size=8))


def plain_alignments(seed, one, two, least_ec):
    """All sets of pairs that a seed leads to and to which none can be added."""
    inner = lambda nodes, edges: sum(u in nodes and v in nodes for u, v in edges)
    kept = lambda m: sum(u in m and v in m and tuple(sorted((m[u], m[v]))) in two for u, v in one)
    fits = lambda m: kept(m) >= least_ec * max(inner(set(m), one), inner(set(m.values()), two))
    ends, todo, seen = set(), [frozenset(seed)], set()
    while todo:
        pairs = todo.pop()
        if pairs in seen:
            continue
        seen.add(pairs)
        m = dict(pairs)
        free = {(x, y) for x in range(6) for y in range(6) if x not in m and y not in m.values()}
        more = [m | {x: y} for x, y in free if kept(m | {x: y}) > kept(m) and fits(m | {x: y})]
        todo += [frozenset(x.items()) for x in more]
        if not more:
            ends.add(pairs)
    return ends


@pytest.mark.parametrize("few", [100_000, 0])
def test_all_alignments_without_bounds(spark, monkeypatch, few):
    monkeypatch.setattr(lookups, "BROADCAST_EDGES", few)
    two_ = drawn(6, 9, 4)
    one = two_[1:]
    frames = [spark.createDataFrame(x, "src long, dst long") for x in (one, two_)]
    u, v = one[0]
    start = spark.createDataFrame([("s", [u, v], [u, v])], "key string, nodes1 array<bigint>, nodes2 array<bigint>")
    by: dict = {}
    for r in lo.align_all(*frames, start, least_ec=0.7).collect():
        by.setdefault(r["align_id"], set()).add((r["n1"], r["n2"]))
    want = plain_alignments([(u, u), (v, v)], one, set(two_), 0.7)
    assert len(want) > 10 and len(by) == len(want) and set(map(frozenset, by.values())) == want


def test_all_alignments_grow_to_their_ends(spark):
    sf, by = "/root/testdata/sf0.001", {}
    one, two_ = (lo.neighbours(lo.gather(g)) for g in graphs.two_networks(spark, sf))
    for r in queries()["all_alignments"](spark, sf).collect():
        by.setdefault(r["align_id"], {})[r["n1"]] = r["n2"]
    for image in by.values():
        left, right = set(image), set(image.values())
        inner = lambda v, near, side: len(near.get(v, set()) & side)
        kept = sum(image[b] in two_[image[a]] for a in image for b in one[a] & left) // 2
        e1, e2 = sum(inner(a, one, left) for a in left) // 2, sum(inner(b, two_, right) for b in right) // 2
        assert kept >= 0.9 * max(e1, e2)
        votes: dict = {}
        for a, b in image.items():
            for x in one[a] - left:
                for y in two_[b] - right:
                    votes[x, y] = votes.get((x, y), 0) + 1
        assert all(kept + n < 0.9 * max(e1 + inner(x, one, left), e2 + inner(y, two_, right)) for (x, y), n in votes.items())


@pytest.mark.parametrize("name, operator", [("all_alignments", "align_all"), ("grown_alignments", "align")])
def test_alignments_read_written_networks(spark, monkeypatch, name, operator):
    sf, seen, indexed = "/root/testdata/sf0.001", [], []
    want = sorted(map(str, queries()[name](spark, sf).collect()))
    real, index = getattr(lo, operator), ix.index
    monkeypatch.setattr(lo, operator, lambda one, two, *x, **y: seen.extend([one, two]) or real(one, two, *x, **y))
    monkeypatch.setattr(ix, "index", lambda edges, *x: indexed.append(edges) or index(edges, *x))
    assert want and sorted(map(str, queries()[name](spark, sf).collect())) == want
    assert len(indexed) == 2 and all("/loop-" in f for g in seen + indexed for f in g.inputFiles())
