"""Operators of the second round against plain Python."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from motiflake.functions import udfs
from motiflake.operators import aggregate as ag
from motiflake.operators import cliques as cq
from motiflake.operators import enumerate as en
from motiflake.operators import fast_sampling as fs
from motiflake.operators import graph_loops as gl
from motiflake.operators import local as lo
from motiflake.operators import measures as ms
from motiflake.operators import sampling as sp
from motiflake.plans import catalogs
from motiflake.sources import formats


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted(rng.sample(list(combinations(range(n), 2)), m))


EDGES = random_edges(24, 70, 1) + [(100, 101), (101, 102)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long").repartition(3).cache()


def near(pairs):
    out = {}
    for u, v in pairs:
        out.setdefault(u, set()).add(v)
        out.setdefault(v, set()).add(u)
    return out


@pytest.mark.parametrize("pairs", [EDGES, random_edges(9, 30, 2), [(0, 1)], [(0, i) for i in range(1, 9)]])
def test_four_node_orbits_by_closed_form(spark, pairs):
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["node"]: tuple(r)[1:] for r in ms.exact_orbits4(df).collect()}
    three = {r["node"]: [r[f"o{i}"] for i in range(4)] for r in ms.exact_orbits(df).collect()}
    four = {r["node"]: list(tuple(r)[1:]) for r in ag.orbit_table(en.connected_sets(df, 4), 4).collect()}
    assert got == {v: tuple(three[v] + four.get(v, [0] * 11)) for v in three}
    want = {r["ordinal"]: r["count"] for r in ag.frequency(en.connected_sets(df, 4), 4).collect()}
    assert {r["ordinal"]: r["count"] for r in ms.graphlet_counts4(ms.exact_orbits4(df)).collect()} == want


@pytest.mark.parametrize("method", sp.METHODS)
@pytest.mark.parametrize("k", [3, 4, 5])
def test_samples_are_the_same_at_any_size(edges, monkeypatch, method, k):
    own = sorted(map(str, fs.grow(edges, k, 300, method, seed=5).collect()))
    monkeypatch.setattr(fs, "MOST_EDGES", 10)
    assert sorted(map(str, fs.grow(edges, k, 300, method, seed=5).collect())) == own
    assert fs.grow(edges.limit(0), k, 5, method).count() == 0


def test_walks_from_all_edges_and_windows(edges):
    rows = sp.walk_from_all(edges, 3, 3).collect()
    assert {r["chain"] for r in rows} == set(range(len(EDGES)))
    links = near(EDGES)
    found = sp.window_walk(edges, 5, 40, 15).collect()
    assert found and len({r["window"] for r in found}) == len(found)
    for r in found:
        held, left = {r["nodes"][0]}, set(r["nodes"][1:])
        while grown := {v for v in left if links[v] & held}:
            held |= grown
            left -= grown
        assert len(r["nodes"]) == 5 and not left


def test_hops_in_blocks(edges):
    links, want = near(EDGES), Counter()
    for s in links:
        depth, walk = {s: 0}, [s]
        for v in walk:
            for w in links[v] - set(depth):
                depth[w] = depth[v] + 1
                walk.append(w)
        want.update(d for d in depth.values() if d)
    for block in (4096, 7):
        assert {r["hops"]: r["pairs"] for r in gl.hop_distribution(edges, block=block).collect()} == dict(want)
    assert {r["hops"] for r in gl.hop_distribution(edges, 2).collect()} == {1, 2}
    assert gl.hop_distribution(edges.limit(0)).count() == 0


def test_betweenness(spark, edges):
    links = near(EDGES)

    def paths(s, t):
        out, left = [], [[s]]
        while left and not out:
            left = [p + [w] for p in left for w in links[p[-1]] if w not in p]
            out = [p for p in left if p[-1] == t]
        return out

    node, edge, far = Counter(), Counter(), 0
    for s, t in combinations(links, 2):
        if s < 100 and t < 100:
            found = paths(s, t)
            far = max(far, len(found[0]) - 1)
            for p in found:
                node.update({v: 1 / len(found) for v in p[1:-1]})
                for u, v in zip(p, p[1:]):
                    edge[frozenset((u, v))] += 1 / len(found)
    row = lo.global_measures(edges).first()
    assert row["components"] == 2 and row["diameter"] == far
    assert row["node_betweenness"] == pytest.approx(max(node.values()), abs=1e-5)
    assert row["edge_betweenness"] == pytest.approx(max(edge.values()), abs=1e-5)


@pytest.mark.parametrize("block", [3, 1000])
def test_similar_pairs_with_few_equal_vectors(spark, block):
    rng = random.Random(4)
    weights = ms.orbit_weights([1, 2, 2, 2])
    one = [(i, [rng.randint(0, 40) for _ in range(4)]) for i in range(40)]
    two = [(i + 50, one[i][1] if i % 9 == 0 else [rng.randint(0, 40) for _ in range(4)]) for i in range(35)]
    frame = lambda rows: spark.createDataFrame(rows, "node long, vector array<long>")
    import numpy as np

    every = []
    for a, x in one:
        for b, y in two:
            s = ms._similarity(np.array(weights), np.array([x], float), np.array([y], float))[0, 0]
            every.append((-s, a, b))
    got = ms.top_pairs(frame(one), frame(two), weights, 12, block=block).collect()
    assert [(-r["similarity"], r["n1"], r["n2"]) for r in got] == sorted(every)[:12]
    same = [(i, [1, 2, 3, 4]) for i in range(30)]
    got = ms.top_pairs(frame(same), frame(same), weights, 5, block=block).collect()
    assert [(r["n1"], r["n2"]) for r in got] == [(0, i) for i in range(5)]


@pytest.mark.parametrize("k", [3, 4, 5])
def test_cliques_from_drawn_edges(spark, k):
    df = spark.createDataFrame(random_edges(12, 50, 3), "src long, dst long")
    exact = cq.exact(df, k).first()[0]
    assert cq.graft(df, k, 1.0).first()[0] == pytest.approx(exact)


def test_near_top(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.95), (3, 1.0)], "id long, score double")
    seen = {sp.near_top(rows, "score", 0.1, "id", seed=s).first()["id"] for s in range(12)}
    assert seen == {2, 3}
    assert sp.near_top(rows.limit(0), "score", 0.1, "id").count() == 0


def test_searches_refuse_what_they_cannot_hold(spark, edges, monkeypatch):
    similar = spark.createDataFrame([(i, i, 1.0) for i in range(6)], "n1 long, n2 long, similarity double")
    seeds = spark.createDataFrame([("s", [1], [1])], "key string, nodes1 array<bigint>, nodes2 array<bigint>")
    few = edges.limit(3)
    monkeypatch.setattr(lo, "MOST_EDGES", 4)
    for call in (
        lambda: lo.align(few, few, seeds, similar),
        lambda: lo.align_all(few, few, seeds, similar),
        lambda: lo.select_blocks(few, few, similar.selectExpr("string(n1) AS align_id", "n1", "n2"), 0.1, 5),
        lambda: lo.gather(edges),
    ):
        with pytest.raises(ValueError, match="over 4"):
            call()


def test_merging_over_a_floor(spark):
    one = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (5, 6)], "src long, dst long")
    rows = [("a", 0, 0), ("a", 1, 1), ("b", 1, 1), ("b", 2, 2), ("c", 1, 1), ("c", 2, 4)]
    df = spark.createDataFrame(rows, "align_id string, n1 long, n2 long")
    scored = {r["align_id"]: r for r in lo.scores_by_alignment(one, one, df).collect()}
    for name in "abc":
        own = ms.alignment_scores(one, one, df.filter(F.col("align_id") == name)).first()
        assert (own["ea"], own["e1"], own["e2"], own["s3"]) == tuple(scored[name][c] for c in ("ea", "e1", "e2", "s3"))
    assert [(r["a1"], r["a2"], r["pairs"], r["s3"]) for r in lo.merge_with_floor(one, one, df, 1.0).collect()] == [("a", "b", 3, 1.0)]
    assert lo.merge_with_floor(one, one, df, 0.0, growth=2.0).count() == 0


def test_objectives_and_rewiring_towards(spark):
    a, b = (spark.createDataFrame(random_edges(16, 40, s), "src long, dst long") for s in (1, 2))
    told = [lo._profile(lo.neighbours(lo.gather(x))) for x in (a, b)]
    assert all(v == pytest.approx(0) for v in lo.objectives(told[0], told[0]).values())
    before = lo.objectives(*told)
    assert set(before) == set(lo.OBJECTIVES) and before["euclidean"] > 0
    for made in (lo.rewire_towards(a, b, {"euclidean": 1.0}, 150), lo.rewire_in_rounds(a, b, {"euclidean": 1.0, "node_histogram": 0.5}, 60, [20, 60])):
        after = lo.objectives(lo._profile(lo.neighbours(lo.gather(made))), told[1])
        assert after["euclidean"] <= before["euclidean"]
    made = lo.rewire_towards(a, b, {"euclidean": 1.0}, 150)
    assert lo.objectives(lo._profile(lo.neighbours(lo.gather(made))), told[1])["euclidean"] < before["euclidean"]


def test_functions_for_sql(spark, edges):
    from motiflake.functions import graphlets

    udfs.register(spark)
    got = spark.sql("SELECT g, canonicalize(g, 4) AS c FROM (SELECT explode(array(0, 5, 63, NULL)) AS g)").collect()
    assert {r["g"]: r["c"]["canonical"] for r in got if r["g"] is not None} == {g: graphlets.canonicalize(g, 4)[0] for g in (0, 5, 63)}
    assert [r["c"]["canonical"] if r["c"] else None for r in got if r["g"] is None] == [None]
    edges.createOrReplaceTempView("some_edges")
    rows = spark.sql("SELECT * FROM sample_graphlets(TABLE(some_edges) WITH SINGLE PARTITION, 4, 200, 'NBE')").collect()
    want = fs.grow(edges, 4, 200, "NBE", 1).collect()
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_checked_files(spark, tmp_path):
    def written(text):
        path = tmp_path / f"g{random.random()}.txt"
        path.write_text(text)
        return str(path)

    assert sorted(map(tuple, formats.checked(spark, written("4 3\n0 1\n\n3 2\n1 2\n")).collect())) == [(0, 1), (1, 2), (3, 2)]
    for text, told in (("3 1\n0 3\n", "not from 0 to 2"), ("3 1\n1 1\n", "one node"), ("3 2\n0 1\n1 0\n", "twice"), ("3 2\n0 1\n", "1 edges, not 2"), ("x\n", "first line")):
        with pytest.raises(ValueError, match=told):
            formats.checked(spark, written(text))


def test_ranked_seeds(spark, tmp_path):
    path = tmp_path / "seeds.txt"
    path.write_text("".join(f"k{i} {i},1 {i},2 {0.5 if i < 8 else 0.9}\n" for i in range(10)))
    rows = formats.ranked_seeds(spark, str(path), 3).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(10)) and {r["key"] for r in rows[:2]} == {"k8", "k9"}
    assert [r["line_no"] for r in rows[2:]] != list(range(8)) and sorted(r["line_no"] for r in rows) == list(range(10))
    assert [r["key"] for r in formats.ranked_seeds(spark, str(path), 3).orderBy("place").collect()] == [r["key"] for r in rows]


def test_maps_that_differ_by_automorphisms_are_alike(spark):
    own, places = catalogs.canon_map(spark, 4), catalogs.orbits(spark, 4)
    whole = places.groupBy("ordinal").agg(F.sort_array(F.collect_list(F.struct("pos", "orbit"))).alias("o"))
    # the two nodes of the last pair in one orbit exchanged
    swap = F.aggregate(
        F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: F.get("o", i)["orbit"] == F.get("o", F.lit(0))["orbit"]), F.lit(0), lambda s, i: i
    )
    turned = own.join(whole, "ordinal").withColumn("j", swap).select(
        "gint", "ordinal", F.transform("perm", lambda p, i: F.when(i == 0, F.get("perm", F.col("j"))).when(i == F.col("j"), F.get("perm", F.lit(0))).otherwise(p)).alias("perm")
    )
    assert turned.join(own, ["gint", "ordinal", "perm"], "left_anti").count() > 0
    assert catalogs.map_differences(own, turned, places).count() == 0
    assert catalogs.map_differences(own, own.filter("gint <> 7"), places).collect()[0]["gint"] == 7
    mixed = own.withColumn("perm", F.reverse("perm"))
    assert catalogs.map_differences(own, mixed, places).count() > 0


def test_remains_of_the_optional_part_do_no_harm(tmp_path):
    """The entry points work where the folder for training text is gone but for what Python left in it."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "motiflake"), tmp_path / "motiflake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    (tmp_path / "motiflake" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'edges_clean' in q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
