"""Operators against plain Python on small random graphs."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from motiflake.functions import graphlets as g
from motiflake.operators import aggregate as ag
from motiflake.operators import cliques as cq
from motiflake.operators import enumerate as en
from motiflake.operators import fast_sampling as fs
from motiflake.operators import graph_loops as gl
from motiflake.operators import index as ix
from motiflake.operators import measures as ms
from motiflake.operators import normalize as nm
from motiflake.operators import sampling as sp
from motiflake.operators import windows as wi


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted(rng.sample(list(combinations(range(n), 2)), m))


EDGES = random_edges(24, 55, 1) + [(100, 101), (101, 102)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long").cache()


def near(edges):
    out = {}
    for u, v in edges:
        out.setdefault(u, set()).add(v)
        out.setdefault(v, set()).add(u)
    return out


def gint(nodes, links):
    k = len(nodes)
    return g.encode([(i, j) for i, j in combinations(range(k), 2) if nodes[j] in links[nodes[i]]], k)


def all_sets(edges, k):
    links = near(edges)
    return {s: gint(s, links) for s in combinations(sorted(links), k) if g.is_connected(gint(s, links), k)}


@pytest.mark.parametrize("k", [3, 4, 5])
def test_enumeration(edges, k):
    want = all_sets(EDGES, k)
    got = en.sort_sets(en.connected_sets(edges, k), k).collect()
    assert len(got) == len(want)
    assert {tuple(r["nodes"]): r["gint"] for r in got} == want


def test_six_and_seven_nodes(spark):
    few = random_edges(10, 16, 3)
    df = spark.createDataFrame(few, "src long, dst long")
    for k in (6, 7):
        sets = ag.classify(en.connected_sets(df, k), k).collect()
        want = all_sets(few, k)
        assert len(sets) == len(want)
        ranks = {x: i for i, x in enumerate(g.canonical_numbers(k))}
        assert Counter(r["ordinal"] for r in sets) == Counter(ranks[g.canonicalize(x, k)[0]] for x in want.values())


def test_large_forms_do_not_depend_on_labels(spark):
    rng = random.Random(2)
    k, rows = 9, []
    for i in range(12):
        e = rng.sample(list(combinations(range(k), 2)), 14)
        for _ in range(3):
            p = rng.sample(range(k), k)
            rows.append((i, g.encode([(p[a], p[b]) for a, b in e], k)))
    df = ag.dynamic_form(spark.createDataFrame(rows, "i int, gint long"), k)
    assert df.groupBy("i").agg(F.countDistinct("form").alias("n")).filter("n > 1").count() == 0


def test_vectors(edges):
    sets4 = en.connected_sets(edges, 4)
    want: Counter = Counter()
    ordinal, perm, _ = g.canonical_map(4)
    for s, x in all_sets(EDGES, 4).items():
        for pos in range(4):
            want[(s[perm[x][pos]], g.catalog(4).orbits[ordinal[x]][pos])] += 1
    got = {(r["node"], r["orbit"]): r["count"] for r in ag.orbit_degrees(sets4, 4).collect()}
    assert got == dict(want)
    totals = {r["ordinal"]: r["count"] for r in ag.graphlet_totals(ag.orbit_degrees(sets4, 4), 4).collect()}
    counts = {r["ordinal"]: r["count"] for r in ag.counts(sets4, 4).collect()}
    assert totals == counts
    assert sum(r["concentration"] for r in ag.concentration(sets4, 4).collect()) == pytest.approx(1)
    assert ag.star_multiplier(edges, ag.counts(sets4, 4), 4).first()["multiplier"] == 1
    table = ag.orbit_table(sets4, 4)
    assert len(table.columns) == 12 and table.agg(F.sum("o3")).first()[0] >= 0


def test_closed_forms_agree(edges):
    closed = {r["node"]: tuple(r)[1:] for r in ms.exact_orbits(edges).collect()}
    links = near(EDGES)
    three = Counter()
    for s, x in all_sets(EDGES, 3).items():
        for v in s:
            inner = len(links[v] & set(s))
            three[(v, 3 if bin(x).count("1") == 3 else (2 if inner == 2 else 1))] += 1
    assert closed == {v: (len(links[v]), three[(v, 1)], three[(v, 2)], three[(v, 3)]) for v in links}


def test_index_rows_have_equal_graphs(edges):
    links = near(EDGES)
    for r in ag.index_rows(en.connected_sets(edges, 4), 4, style="decimal").collect():
        assert gint(r["nodes"], links) == int(r["id"])
    few = ag.index_rows(en.connected_sets(edges, 4), 4, rooted=True, least_edges=5, ambiguity=4)
    assert {r["id"].split("+")[0] for r in few.collect()} <= {"9", "10"}


def test_directed(spark, edges):
    rng = random.Random(4)
    arcs = [(u, v) if rng.random() < 0.5 else (v, u) for u, v in EDGES] + [(v, u) for u, v in EDGES[:20]]
    df = spark.createDataFrame(arcs, "src long, dst long").distinct()
    sets = en.connected_sets(edges, 3).select(F.monotonically_increasing_id().alias("set_id"), "nodes")
    got = {r["ordinal"]: r["count"] for r in ag.counts(en.induced_gint(sets, df, 3, directed=True), 3, directed=True).collect()}
    ordinal = g.canonical_map(3, True)[0]
    have = set(df.collect())
    have = {(r["src"], r["dst"]) for r in have}
    want = Counter(
        int(ordinal[g.encode([(i, j) for i in range(3) for j in range(3) if (s[i], s[j]) in have], 3, True)]) for s in all_sets(EDGES, 3)
    )
    assert got == dict(want)


def test_cliques(spark, edges):
    links = near(EDGES)
    want = lambda k: sum(all(b in links[a] for a, b in combinations(s, 2)) for s in combinations(sorted(links), k))
    for k in (3, 4):
        assert cq.exact(edges, k).first()[0] == want(k)
    whole = spark.createDataFrame(list(combinations(range(9), 2)), "src long, dst long")
    assert cq.exact(whole, 5).first()[0] == 126
    assert cq.turan_shadow(whole, 5, 300).first()[0] == pytest.approx(126)
    assert cq.graft(whole, 3, 1.0).first()[0] == pytest.approx(84)
    assert cq.edge_sampling(whole, 3, 1.0).first()[0] == 84
    many = [cq.color_coding(whole, 3, seed=s).first()[0] for s in range(6)]
    assert 40 < sum(many) / len(many) < 130
    assert en.wedges(whole).first()[0] == 9 * 28


def test_loops(spark, edges):
    parts = {r["id"]: r["cc"] for r in gl.components(edges).collect()}
    assert parts[102] == 100 and parts[EDGES[0][0]] == min(v for v in parts if v < 100)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert gl.components(chain).select("cc").distinct().collect()[0][0] == 0
    hops = {r["hops"]: r["pairs"] for r in gl.hop_distribution(chain, 70).collect()}
    assert hops == {h: 2 * (61 - h) for h in range(1, 61)}
    whole = list(combinations(range(6), 2)) + [(0, 10), (10, 11)]
    core = {r["id"]: r["core"] for r in gl.cores(spark.createDataFrame(whole, "src long, dst long")).collect()}
    assert core == {**{i: 5 for i in range(6)}, 10: 1, 11: 1}
    assert gl.importance(edges, 2).agg(F.sum("importance")).first()[0] > 0
    shares = sp.component_shares(edges, 3).orderBy("upto").collect()
    assert [r["size"] for r in shares] == sorted((r["size"] for r in shares), reverse=True) and shares[-1]["upto"] == pytest.approx(1)


@pytest.mark.parametrize("method", ["NBE", "EBE"])
def test_samplers_are_unbiased(edges, method):
    exact = {r["ordinal"]: r["concentration"] for r in ag.concentration(en.connected_sets(edges, 4), 4).collect()}
    rows = sp.grow(edges, 4, 6000, method, seed=2).cache()
    links = near(EDGES)
    for r in rows.limit(50).collect():
        assert gint(r["nodes"], links) == r["gint"] and len(set(r["nodes"])) == 4
    got = {r["ordinal"]: r["concentration"] for r in sp.estimate(rows, edges, 4, method).collect()}
    assert set(got) == set(exact)
    assert max(abs(got[o] - exact[o]) for o in exact) < 0.05


def test_samples_do_not_depend_on_partitions(spark, edges):
    one = sorted(map(str, sp.grow(edges, 4, 200, "EBE", seed=7).collect()))
    two = sorted(map(str, sp.grow(edges.repartition(7), 4, 200, "EBE", seed=7).collect()))
    assert one == two
    assert one != sorted(map(str, sp.grow(edges, 4, 200, "EBE", seed=8).collect()))


def test_other_samplers(spark, edges):
    links = near(EDGES)
    for r in sp.accept_reject(edges, 3, 3000).collect():
        assert r["nodes"] == sorted(r["nodes"]) and g.is_connected(gint(r["nodes"], links), 3)
    walked = sp.walk(edges, 4, 300, 6)
    told = en.induced_gint(walked.select(F.xxhash64("chain", "step").alias("s"), "nodes"), edges, 4, key="s").collect()
    assert told and all(g.is_connected(r["gint"], 4) for r in told)
    kept = sp.reservoir(edges, 3, 50, rounds=3).collect()
    assert kept and all(g.is_connected(r["gint"], 3) and len(r["nodes"]) == 3 for r in kept)
    covered = sp.edge_cover(edges, 3, 6)
    pairs = {frozenset(p) for r in covered.collect() for p in combinations(r["nodes"], 2)}
    assert sum(frozenset(e) in pairs for e in EDGES) > 0.9 * len(EDGES)
    told, batches = sp.until_precise(edges, 3, "NBE", 400, 0.9, most=4)
    assert 3 <= batches <= 4 and told.count() == 2
    twice = spark.createDataFrame([(1, [3, 1]), (0, [1, 3]), (2, [4, 5])], "sample long, nodes array<bigint>")
    assert sorted(r["sample"] for r in sp.recent_once(twice).collect()) == [0, 2]


def test_walk_is_unbiased_for_three_nodes(edges):
    rows = sp.walk(edges, 3, 3000, 5).filter("step = 5").withColumn("sample", F.col("chain"))
    told = en.induced_gint(rows.select("sample", "nodes"), edges, 3, key="sample").join(rows.select("sample", "multiplier"), "sample")
    got = {r["ordinal"]: r["concentration"] for r in sp.estimate(told, edges, 3, "MCMC").collect()}
    exact = {r["ordinal"]: r["concentration"] for r in ag.concentration(en.connected_sets(edges, 3), 3).collect()}
    assert max(abs(got[o] - exact[o]) for o in exact) < 0.08


def test_index_and_patches(edges):
    links = near(EDGES)
    heur = nm.degrees(edges).select("id", F.col("deg").cast("double").alias("heur"))
    k, top = 4, 1
    want = set()

    def step(path):
        if len(path) == k:
            want.add(tuple(sorted(path)))
            return
        free = set().union(*(links[v] for v in path)) - set(path)
        if free:
            best = sorted({len(links[v]) for v in free}, reverse=True)[:top]
            for v in free:
                if len(links[v]) in best:
                    step([*path, v])

    for v in links:
        step([v])
    got = ix.expand(edges, heur, k, top).collect()
    assert {tuple(sorted(r["nodes"])) for r in got} == want and len(got) == len(want)
    lines = ix.index(edges, heur, k, top, most=4).cache()
    rows = lines.orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == list(range(len(rows)))
    expected = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 : i + 3]:
            if set(a["nodes"]) & set(b["nodes"]):
                left, right = (a, b) if a["key"] <= b["key"] else (b, a)
                l_, r_ = left["nodes"], right["nodes"]
                both = [x for x in l_ if x in r_]
                extra = {}
                for x in l_:
                    if x not in r_:
                        js = [r_.index(y) for y in r_ if y not in l_ and y in links[x]]
                        if js:
                            extra[l_.index(x)] = js
                poses = ",".join(f"{l_.index(x)}:{r_.index(x)}" for x in both)
                text = "-".join(f"{i_}:{','.join(map(str, js))}" for i_, js in sorted(extra.items()))
                nodes = [x for x in l_ if x not in r_] + both + [x for x in r_ if x not in l_]
                expected.append((f"{left['key']}-{right['key']};{poses};{text}", tuple(nodes)))
    found = ix.patches(lines, edges).cache()
    assert sorted((r["key"], tuple(r["nodes"])) for r in found.collect()) == sorted(expected)
    alone = Counter(k_ for k_, _ in expected)
    seeds = ix.seeds(found, found)
    assert seeds.count() == sum(n == 1 for n in alone.values())
    same = nm.nodes(edges).select(F.col("id").alias("n1"), F.col("id").alias("n2"))
    metrics = ix.seed_metrics(seeds, same).first()
    assert metrics["node_correctness"] == pytest.approx(metrics["avg_size"] ** 0 * metrics["node_correctness"])
    assert metrics["right_pairs"] <= metrics["pairs"]


def test_windows(spark, edges):
    links = near(EDGES)
    rng = random.Random(5)
    windows = [(i, sorted(rng.sample(sorted(links), 7))) for i in range(20)]
    df = spark.createDataFrame(windows, "window long, nodes array<bigint>")
    got = wi.window_sets(df, edges, 7, 4).cache()
    ordinal = g.canonical_map(4)[0]
    want = {(w, s): int(ordinal[gint(s, links)]) for w, nodes in windows for s in combinations(nodes, 4) if g.is_connected(gint(s, links), 4)}
    assert {(r["window"], tuple(r["nodes"])): r["ordinal"] for r in got.collect()} == want
    by = {}
    for (w, _), o in want.items():
        by.setdefault(w, []).append(o)
    low = {r["window"]: r["ordinal"] for r in wi.representatives(got, 4, "MIN").collect()}
    assert low == {w: min(os) for w, os in by.items()}
    rare = {r["window"]: r["ordinal"] for r in wi.representatives(got, 4, "LFMAX").collect()}
    assert rare == {w: min(Counter(os).items(), key=lambda x: (x[1], -x[0]))[0] for w, os in by.items()}
    assert wi.limited(got, edges, "DEG", 1).groupBy("window").count().filter("count > 1").count() == 0
    grown = wi.by_degree(edges, 4, nm.nodes(edges)).collect()
    assert all(len(set(r["nodes"])) == 4 for r in grown) and 100 not in {r["window"] for r in grown}


def test_prediction_finds_a_removed_edge(spark):
    ring = [(i, (i + 1) % 8) for i in range(8)] + [(i, i + 2) for i in range(6)]
    kept = spark.createDataFrame([(min(e), max(e)) for e in ring if set(e) != {2, 3}], "src long, dst long")
    scored = ms.predict(en.connected_sets(kept, 4), kept, 4, 11, 11)
    assert scored.filter("score <= 0").count() == 0
    test = spark.createDataFrame([(2, 3)], "src long, dst long")
    assert ms.hold_out(scored, kept, test, 100).first()["hits"] == 1


def test_measures(spark, edges):
    same = nm.nodes(edges).select(F.col("id").alias("n1"), F.col("id").alias("n2"))
    row = ms.alignment_scores(edges, edges, same).first()
    assert (row["ec1"], row["ec2"], row["s3"]) == (1, 1, 1)
    counts = ag.counts(en.connected_sets(edges, 4), 4)
    zero = ms.count_objectives(counts, counts).first()
    assert (zero["euclidean"], zero["kernel"], zero["senatorial"]) == (0, pytest.approx(0), 0)
    assert ms.hamming_objective(counts, counts, 4).first()[0] == 0
    deg = nm.degree_distribution(edges)
    assert ms.distribution_distance(deg, deg, "deg").first()["ks"] == 0
    vectors = ms.exact_orbits(edges).select("node", F.array("o0", "o1", "o2", "o3").alias("vector"))
    best = ms.top_pairs(vectors, vectors, ms.orbit_weights([1, 2, 2, 2]), 10, block=8).collect()
    assert len(best) == 10 and all(r["similarity"] == 1 for r in best)
    perfect = spark.createDataFrame([(3.0, 1), (2.0, 1), (1.0, 0)], "score double, label int")
    assert tuple(ms.ranking_quality(perfect).first()) == (1, 1)
    whole = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.lit(1))
    assert ms.modularity(edges, whole).first()[0] == pytest.approx(0)


def test_normal_forms(spark, edges):
    raw = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 5)], "src long, dst long")
    assert sorted(map(tuple, nm.clean(raw).collect())) == [(1, 2), (2, 5)]
    named = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    numbered, names = nm.encode_names(named)
    assert {r["name"]: r["id"] for r in names.collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted(map(tuple, numbered.collect())) == [(1, 0), (2, 1)]
    parts = nm.split(edges, 10, 3).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"test": 6, "train": len(EDGES) - 6}
    assert nm.erdos_renyi(spark, 50, 100, 1).distinct().count() == 100
    chain = nm.chained_canonicals(spark, 4)
    found = {r["ordinal"] for r in ag.counts(en.connected_sets(chain, 4), 4).collect()}
    assert found == {3, 6, 7, 8, 9, 10}
    with pytest.raises(ValueError):
        nm.complement(edges, most=3)
    lines = spark.createDataFrame([("x", 0), ("y", 1), ("x", 2)], "line string, line_no long")
    assert sorted(map(tuple, nm.distinct_lines(lines).collect())) == [("x", 0), ("y", 1)]


def test_communities_and_neighbours(edges):
    rows = ag.communities(en.connected_sets(edges, 3), 3, symmetric=True).collect()
    links = near(EDGES)
    assert all(set(r["neighbours"]) <= links[r["node"]] for r in rows)
    tri = {r["node"]: r["count"] for r in rows if r["id"] == 5}
    want = Counter(v for s, x in all_sets(EDGES, 3).items() if bin(x).count("1") == 3 for v in s)
    assert tri == dict(want)


@pytest.mark.parametrize("method", ["NBE", "EBE", "PLAIN"])
def test_whole_array_samplers(spark, edges, method, monkeypatch):
    rows = fs.grow(edges, 4, 20000, method, seed=3).cache()
    links = near(EDGES)
    for r in rows.limit(60).collect():
        assert gint(r["nodes"], links) == r["gint"] and len(set(r["nodes"])) == 4
    exact = {r["ordinal"]: r["concentration"] for r in ag.concentration(en.connected_sets(edges, 4), 4).collect()}
    if method != "PLAIN":
        got = {r["ordinal"]: r["concentration"] for r in sp.estimate(rows, edges, 4, method).collect()}
        assert max(abs(got[o] - exact[o]) for o in exact) < 0.02
    again = fs.grow(edges.repartition(5), 4, 300, method, seed=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.filter("sample < 300").collect()))
    monkeypatch.setattr(fs, "MOST_EDGES", 10)
    few = fs.grow(edges, 4, 40, method, seed=3).collect()
    assert few and all(gint(r["nodes"], links) == r["gint"] for r in few)


def test_multipliers_by_hand(edges):
    links = near(EDGES)
    for method in ("NBE", "EBE"):
        for rows in (fs.grow(edges, 4, 200, method, seed=4), sp.grow(edges, 4, 100, method, seed=4)):
            for r in rows.collect():
                want = 1
                for p in (2, 3):
                    held = r["nodes"][:p]
                    out = [w for v in held for w in links[v] if w not in held]
                    want *= len(out) if method == "EBE" else len(set(out))
                assert r["multiplier"] == want
