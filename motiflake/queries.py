"""The engine's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import graphlets
from .operators import aggregate as ag
from .operators import cliques as cq
from .operators import enumerate as en
from .operators import fast_sampling as fs
from .operators import graph_loops as gl
from .operators import index as ix
from .operators import local as lo
from .operators import measures as ms
from .operators import normalize as nm
from .operators import sampling as sp
from .operators import windows as wi
from .plans import catalogs
from .functions import udfs
from .plans.stash import shared_folder, stash
from .sources import formats, graphs, sinks
from . import oracle as sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: SQL, or what makes it when it is asked for.
ORACLE: dict[str, str | Callable[[], str]] = {}


def query(oracle: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


# ---- graphs and their measures


@query(f"WITH {sql.G12} SELECT src, dst FROM edges")
def edges_clean(spark, sf_dir):
    return graphs.g12(spark, sf_dir)


@query(f"WITH {sql.G12}, {sql.BOTH} SELECT u AS id, list_sort(list(v))::VARCHAR AS nbrs, count(*)::INTEGER AS deg FROM b GROUP BY u")
def adjacency_lists(spark, sf_dir):
    near = nm.adjacency(graphs.g12(spark, sf_dir))
    return near.select("id", F.concat(F.lit("["), F.array_join("nbrs", ", "), F.lit("]")).alias("nbrs"), "deg")


@query(f"WITH {sql.G12}, {sql.BOTH} SELECT deg, count(*) AS nodes FROM (SELECT u, count(*) AS deg FROM b GROUP BY u) GROUP BY deg")
def degree_distribution(spark, sf_dir):
    return nm.degree_distribution(graphs.g12(spark, sf_dir))


@query(
    f"WITH {sql.G12}, {sql.BOTH}, d AS (SELECT u, count(*) AS deg FROM b GROUP BY u), s AS (SELECT count(*) AS n, (sum(deg) // 2)::BIGINT AS m, max(deg) AS max_deg FROM d) "
    "SELECT n, m, round(m / (n * (n - 1) / 2), 12) AS density, max_deg FROM s"
)
def graph_stats(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    found = nm.stats(edges).join(F.broadcast(nm.max_degree(edges)))
    return found.withColumn("density", F.round("density", 12))


@query(f"WITH {sql.G12W} SELECT src, dst, weight FROM edges")
def edges_weighted(spark, sf_dir):
    return graphs.g12_weighted(spark, sf_dir)


@query(f"WITH {sql.G12}, keep AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)")
def induced_subgraph(spark, sf_dir):
    keep = graphs.table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return nm.induced(graphs.g12(spark, sf_dir), keep)


@query(f"WITH {sql.G12}, {sql.BOTH}, n AS (SELECT DISTINCT u AS id FROM b) SELECT id FROM n QUALIFY row_number() OVER (ORDER BY {sql.draw('id', 5)}, id) <= floor((SELECT count(*) FROM n) * 0.3)")
def random_nodes(spark, sf_dir):
    return nm.random_nodes(graphs.g12(spark, sf_dir), 0.3, 5)


@query(f"WITH {sql.G12} SELECT src, dst FROM edges WHERE {sql.draw('src', 'dst', 3)} >= 429496729")
def soften_edges(spark, sf_dir):
    return nm.soften(graphs.g12(spark, sf_dir), 0.1, 3)


@query(f"WITH {sql.TRADE}, {sql.BOTH}, n AS (SELECT DISTINCT u AS id FROM b) SELECT a.id AS src, c.id AS dst FROM n a JOIN n c ON a.id < c.id WHERE (a.id, c.id) NOT IN (SELECT (src, dst) FROM edges)")
def complement_of_trade(spark, sf_dir):
    return nm.complement(graphs.trade(spark, sf_dir))


@query(f"WITH {sql.G12} SELECT src, dst, CASE WHEN row_number() OVER (ORDER BY {sql.draw('src', 'dst', 11)}, src, dst) <= ceil((SELECT count(*) FROM edges) * 10 / 100) THEN 'test' ELSE 'train' END AS part FROM edges")
def train_test_split(spark, sf_dir):
    return nm.split(graphs.g12(spark, sf_dir), 10, 11)


@query(f"WITH {sql.G12} SELECT src, dst, row_number() OVER (ORDER BY {sql.draw('src', 'dst', 4)}, src, dst) - 1 AS place FROM edges")
def shuffled_edges(spark, sf_dir):
    return nm.shuffled(graphs.g12(spark, sf_dir), 4)


@query(f"WITH {sql.G12}, {sql.BOTH} SELECT u AS id, count(*) AS deg FROM b GROUP BY u HAVING count(*) > 1")
def minus_degree_one(spark, sf_dir):
    return nm.minus_degree_one(graphs.g12(spark, sf_dir))


@query(f"WITH {sql.G12} SELECT src, dst FROM edges WHERE src <> 7 AND dst <> 7")
def without_node(spark, sf_dir):
    return nm.without_node(graphs.g12(spark, sf_dir), 7)


@query(
    "WITH t AS (SELECT range AS id, " + sql.draw("range", 0, 9) + " % 500 AS a, " + sql.draw("range", 1, 9) + " % 500 AS b FROM range(4016)), "
    "f AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, min(id) AS id FROM t WHERE a <> b GROUP BY 1, 2) SELECT src, dst FROM f ORDER BY id LIMIT 2000"
)
def erdos_renyi(spark, sf_dir):
    return nm.erdos_renyi(spark, 500, 2000, 9)


@query("SELECT DISTINCT least(i, (i + s) % 100) AS src, greatest(i, (i + s) % 100) AS dst FROM (SELECT range AS i FROM range(100)), (SELECT unnest([1, 2, 3]) AS s)")
def ring_lattice(spark, sf_dir):
    return nm.ring_lattice(spark, 100, 3)


@query(
    "SELECT a.range AS src, b.range AS dst FROM range(60) a JOIN range(60) b ON a.range < b.range AND a.range // 6 = b.range // 6 "
    "UNION SELECT least(c * 6 + j, (c + 1) % 10 * 6 + j), greatest(c * 6 + j, (c + 1) % 10 * 6 + j) FROM (SELECT range AS c FROM range(10)), (SELECT unnest([0, 1]) AS j)"
)
def clique_communities(spark, sf_dir):
    return nm.clique_communities(spark, 10, 6, 2)


@query(f"WITH {sql.G12W}, keep AS (SELECT p_partkey AS id FROM part WHERE p_size <= 10), b AS (SELECT src AS u, dst AS v, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) SELECT u AS id, count(*) AS hits, sum(weight) AS weight FROM b WHERE v IN (SELECT id FROM keep) GROUP BY u")
def hits_into_set(spark, sf_dir):
    keep = graphs.table(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("id"))
    return nm.hits_into(graphs.g12_weighted(spark, sf_dir), keep)


@query("SELECT a.c_name AS name1, b.s_name AS name2 FROM customer a JOIN supplier b ON 'x_' || a.c_nationkey = 'x_' || b.s_nationkey")
def ortholog_join(spark, sf_dir):
    one = graphs.table(spark, sf_dir, "customer")
    two = graphs.table(spark, sf_dir, "supplier")
    left = one.select(F.concat_ws("_", "c_name", "c_nationkey").alias("name"))
    right = two.select(F.concat_ws("_", "s_name", "s_nationkey").alias("name"))
    cut = lambda c: F.regexp_replace(c, "_[^_]*$", "")
    return nm.ortholog_pairs(left, right, cut)


@query("SELECT part_name AS name, row_number() OVER (ORDER BY part_name) - 1 AS id FROM (SELECT DISTINCT 'p' || u AS part_name FROM (WITH " + sql.G12 + ", " + sql.BOTH + " SELECT u FROM b))")
def node_dictionary(spark, sf_dir):
    named = graphs.g12(spark, sf_dir).select(F.concat(F.lit("p"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst"))
    return nm.encode_names(named)[1]


# ---- exact enumeration and what is counted over it


@query(f"WITH {sql.G12}, {sql.classified(3)} SELECT o.ordinal, coalesce(c.count, 0) AS count FROM {sql.connected(3)} o LEFT JOIN (SELECT ordinal, count(*) AS count FROM cls GROUP BY 1) c USING (ordinal)")
def graphlet_freq_k3(spark, sf_dir):
    return ag.frequency(en.connected_sets(graphs.g12(spark, sf_dir), 3), 3)


@query(f"WITH {sql.GADJ}, {sql.classified(3)} SELECT o.ordinal, coalesce(c.count, 0) AS count FROM {sql.connected(3)} o LEFT JOIN (SELECT ordinal, count(*) AS count FROM cls GROUP BY 1) c USING (ordinal)")
def graphlet_freq_k3_dense(spark, sf_dir):
    return ag.frequency(en.connected_sets(graphs.gadj(spark, sf_dir), 3), 3)


@query(f"WITH {sql.G12}, {sql.classified(4)} SELECT o.ordinal, coalesce(c.count, 0) AS count FROM {sql.connected(4)} o LEFT JOIN (SELECT ordinal, count(*) AS count FROM cls GROUP BY 1) c USING (ordinal)")
def graphlet_freq_k4(spark, sf_dir):
    return ms.graphlet_counts4(ms.exact_orbits4(graphs.g12(spark, sf_dir)))


@query(f"WITH {sql.G12}, {sql.classified(4)} SELECT o.ordinal, coalesce(c.count, 0) AS count FROM {sql.connected(4)} o LEFT JOIN (SELECT ordinal, count(*) AS count FROM cls GROUP BY 1) c USING (ordinal)")
def graphlet_freq_k4_by_sets(spark, sf_dir):
    return ag.frequency(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4)


@query(f"WITH {sql.G12}, {sql.classified(5)} SELECT o.ordinal, coalesce(c.count, 0) AS count FROM {sql.connected(5)} o LEFT JOIN (SELECT ordinal, count(*) AS count FROM cls GROUP BY 1) c USING (ordinal)")
def graphlet_freq_k5(spark, sf_dir):
    return ag.frequency(en.connected_sets(graphs.g12(spark, sf_dir), 5), 5)


@query(f"WITH {sql.G12}, {sql.classified(4)}, c AS (SELECT ordinal, count(*) AS n FROM cls GROUP BY 1) SELECT o.ordinal, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 9) AS concentration FROM {sql.connected(4)} o LEFT JOIN c USING (ordinal)")
def concentration_k4(spark, sf_dir):
    return ag.concentration(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4)


@query(f"WITH {sql.G12}, {sql.classified(3)}, {sql.orbited(3)} SELECT node, orbit, count(*) AS count FROM orb GROUP BY 1, 2")
def orbit_degrees_k3(spark, sf_dir):
    return ag.orbit_degrees(en.connected_sets(graphs.g12(spark, sf_dir), 3), 3)


@query(f"WITH {sql.G12}, {sql.classified(4)}, {sql.orbited(4)} SELECT node, orbit, count(*) AS count FROM orb GROUP BY 1, 2")
def orbit_degrees_k4(spark, sf_dir):
    return ag.orbit_degrees(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4)


@query(f"WITH {sql.G12}, {sql.classified(5)}, {sql.orbited(5)} SELECT node, orbit, count(*) AS count FROM orb GROUP BY 1, 2")
def orbit_degrees_k5(spark, sf_dir):
    return ag.orbit_degrees(en.connected_sets(graphs.g12(spark, sf_dir), 5), 5)


@query(sql.orbit_table_k4())
def orbit_table_k4(spark, sf_dir):
    rows = ms.exact_orbits4(graphs.g12(spark, sf_dir))
    held = rows.filter(" + ".join(f"o{i}" for i in range(4, 15)) + " > 0")
    return held.select("node", *(F.col(f"o{i + 4}").alias(f"o{i}") for i in range(11)))


@query(sql.orbit_table_k4())
def orbit_table_k4_by_sets(spark, sf_dir):
    return ag.orbit_table(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4)


@query(f"WITH {sql.G12}, {sql.classified(4)}, {sql.orbited(4)} SELECT node, ordinal, count(*) AS count FROM orb GROUP BY 1, 2")
def graphlet_degrees_k4(spark, sf_dir):
    return ag.graphlet_degrees(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4)


@query(f"WITH {sql.G12}, {sql.classified(3)}, {sql.orbited(3)} SELECT node, {', '.join(f'count(*) FILTER (ordinal = {i}) AS g{i}' for i in range(4))} FROM orb GROUP BY 1")
def graphlet_table_k3(spark, sf_dir):
    return ag.graphlet_table(en.connected_sets(graphs.g12(spark, sf_dir), 3), 3)


@query(f"WITH {sql.G12}, {sql.classified(4)} SELECT ordinal, count(*) AS count FROM cls GROUP BY 1")
def graphlet_totals_from_orbits(spark, sf_dir):
    return ag.graphlet_totals(ag.orbit_degrees(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4), 4)


@query(sql.star_multiplier(4))
def star_multiplier_k4(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    return ag.star_multiplier(edges, ag.counts(en.connected_sets(edges, 4), 4), 4)


@query(f"WITH {sql.G12}, {sql.classified(4)} SELECT ordinal::VARCHAR AS id, array_to_string(list_transform(perm, lambda p: s[p + 1]), ' ') AS nodes FROM cls")
def index_rows_k4(spark, sf_dir):
    rows = ag.index_rows(en.sort_sets(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4), 4)
    return rows.select("id", F.array_join("nodes", " ").alias("nodes"))


@query(f"WITH {sql.G12}, {sql.classified(4)} SELECT ordinal || '+o' || perm[1] AS id, array_to_string(list_transform(perm, lambda p: s[p + 1]), ' ') AS nodes FROM cls WHERE ordinal IN ({sql.listed(4, least_edges=4, ways=4)})")
def index_rows_rooted(spark, sf_dir):
    rows = ag.index_rows(en.sort_sets(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4), 4, rooted=True, least_edges=4, ambiguity=4)
    return rows.select("id", F.array_join("nodes", " ").alias("nodes"))


@query(f"WITH {sql.G12}, {sql.classified(4)} SELECT right(c.gint::BIT::VARCHAR, 6) AS id, array_to_string(list_transform(perm, lambda p: s[p + 1]), ' ') AS nodes FROM cls JOIN {sql.canon(4)} c USING (ordinal)")
def index_rows_binary(spark, sf_dir):
    rows = ag.index_rows(en.sort_sets(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4), 4, style="binary")
    return rows.select("id", F.array_join("nodes", " ").alias("nodes"))


@query(sql.orbit_rows(4))
def orbit_rows_k4(spark, sf_dir):
    return ag.orbit_rows(en.sort_sets(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4), 4)


@query(sql.communities(4))
def communities_k4(spark, sf_dir):
    rows = ag.communities(en.sort_sets(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4), 4)
    return rows.select("node", "id", "count", F.array_join("neighbours", " ").alias("neighbours"))


@query(f"WITH {sql.GADJ}, {sql.BOTH} SELECT (sum(d * (d - 1)) // 2)::BIGINT AS wedges FROM (SELECT u, count(*) AS d FROM b GROUP BY u)")
def wedge_count(spark, sf_dir):
    return en.wedges(graphs.gadj(spark, sf_dir))


@query(f"WITH {sql.GADJ} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst")
def triangle_list(spark, sf_dir):
    return en.triangles(graphs.gadj(spark, sf_dir))


@query(f"WITH {sql.ARCS}, {sql.directed_k3()} SELECT ordinal, count(*) AS count FROM cls GROUP BY 1")
def directed_freq_k3(spark, sf_dir):
    arcs = graphs.arcs_between(spark, sf_dir).distinct()
    sets = en.connected_sets(nm.clean(arcs), 3).select(F.array_sort("nodes").alias("set_id"), "nodes")
    return ag.counts(en.induced_gint(sets, arcs, 3, directed=True), 3, directed=True)


# ---- loops over a graph's depth


@query(f"WITH RECURSIVE {sql.G12}, {sql.BOTH}, r(id, x) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, r.x FROM r JOIN b ON b.u = r.id AND r.x < b.v) SELECT id, min(x) AS cc FROM (SELECT id, x FROM r UNION ALL SELECT DISTINCT u, u FROM b) GROUP BY id")
def component_labels(spark, sf_dir):
    return gl.components(graphs.g12(spark, sf_dir))


@query(
    f"WITH RECURSIVE {sql.G12}, {sql.BOTH}, r(id, x) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, r.x FROM r JOIN b ON b.u = r.id AND r.x < b.v), l AS (SELECT id, min(x) AS cc FROM r GROUP BY id), "
    "s AS (SELECT cc, count(*) AS size FROM l GROUP BY 1 HAVING count(*) >= 4), w AS (SELECT cc, size, size::DOUBLE * (size - 1) * (size - 2) * (size - 3) AS ways FROM s), h AS (SELECT cc, size, ways / (SELECT sum(ways) FROM w) AS share FROM w) "
    "SELECT cc, size, round(share, 9) AS share, round(sum(share) OVER (ORDER BY size DESC, cc), 9) AS upto FROM h"
)
def component_shares(spark, sf_dir):
    return sp.component_shares(graphs.g12(spark, sf_dir), 4)


@query(
    f"WITH RECURSIVE {sql.G12}, {sql.BOTH}, d(source, id, hops) USING KEY (source, id) AS (SELECT DISTINCT u, u, 0 FROM b UNION SELECT d.source, b.v, min(d.hops) + 1 FROM d JOIN b ON b.u = d.id "
    "ANTI JOIN recurring.d r ON r.source = d.source AND r.id = b.v GROUP BY 1, 2) SELECT hops, count(*) AS pairs FROM d WHERE hops > 0 GROUP BY 1"
)
def hop_distribution(spark, sf_dir):
    return gl.hop_distribution(graphs.g12(spark, sf_dir))


@query(sql.cores("SELECT id, h AS core FROM est"))
def core_numbers(spark, sf_dir):
    return gl.cores(graphs.g12(spark, sf_dir))


@query()
def node_importance(spark, sf_dir):
    return gl.importance(graphs.g12(spark, sf_dir), 3)


# ---- measures


@query(f"WITH {sql.GADJ}, {sql.BOTH}, t AS (SELECT x.src AS a, x.dst AS m, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst), n AS (SELECT unnest([a, m, c]) AS id FROM t), l AS (SELECT id, count(*) AS links FROM n GROUP BY 1), d AS (SELECT u AS id, count(*) AS deg FROM b GROUP BY 1) SELECT id, deg, coalesce(links, 0) AS links, round(CASE WHEN deg > 1 THEN coalesce(links, 0) / (deg * (deg - 1) / 2) ELSE 0.0 END, 9) AS coefficient FROM d LEFT JOIN l USING (id)")
def clustering_coefficients(spark, sf_dir):
    return ms.clustering(graphs.gadj(spark, sf_dir))


@query(f"WITH {sql.G12}, {sql.classified(3)}, {sql.orbited(3)}, d AS (SELECT u AS node, count(*) AS o0 FROM b GROUP BY 1), o AS (SELECT node, count(*) FILTER (orbit = 3) AS o1, count(*) FILTER (orbit = 4) AS o2, count(*) FILTER (orbit = 5) AS o3 FROM orb GROUP BY 1) SELECT node, o0, coalesce(o1, 0)::BIGINT AS o1, coalesce(o2, 0)::BIGINT AS o2, coalesce(o3, 0)::BIGINT AS o3 FROM d LEFT JOIN o USING (node)")
def exact_orbits_closed_form(spark, sf_dir):
    return ms.exact_orbits(graphs.g12(spark, sf_dir))


@query(sql.exact_orbits4())
def exact_orbits_k4(spark, sf_dir):
    return ms.exact_orbits4(graphs.g12(spark, sf_dir))


_BY_BRAND = "membership AS (SELECT p_partkey AS node, p_brand AS community FROM part)"


@query(f"WITH {sql.G12}, {sql.BOTH}, {_BY_BRAND}, t AS (SELECT x.community AS a, y.community AS c FROM edges LEFT JOIN membership x ON x.node = src LEFT JOIN membership y ON y.node = dst), i AS (SELECT a AS community, count(*) AS inside FROM t WHERE a = c GROUP BY 1), o AS (SELECT community, count(*) AS outside FROM (SELECT unnest([a, c]) AS community FROM t WHERE a IS NULL OR c IS NULL OR a <> c) WHERE community IS NOT NULL GROUP BY 1), s AS (SELECT community, count(*) AS n FROM membership GROUP BY 1), w AS (SELECT count(DISTINCT u) AS al FROM b), j AS (SELECT community, n, coalesce(inside, 0) AS inside, coalesce(outside, 0) AS outside, al FROM s LEFT JOIN i USING (community) LEFT JOIN o USING (community), w) SELECT community, n, inside, outside, round(CASE WHEN n > 1 THEN inside / (n * (n - 1) / 2) ELSE 0.0 END, 9) AS intra_density, round(CASE WHEN n * (al - n) > 0 THEN outside / (n * (al - n)) ELSE 0.0 END, 9) AS inter_density, round(CASE WHEN 2 * inside + outside > 0 THEN outside / (2 * inside + outside) ELSE 0.0 END, 9) AS conductance, round(inside * CASE WHEN n > 1 THEN inside / (n * (n - 1) / 2) ELSE 0.0 END, 9) AS score FROM j")
def community_scores(spark, sf_dir):
    own = graphs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return ms.community_scores(graphs.g12(spark, sf_dir), own)


@query(f"WITH {sql.G12}, {_BY_BRAND}, t AS (SELECT x.community AS a, y.community AS c FROM edges LEFT JOIN membership x ON x.node = src LEFT JOIN membership y ON y.node = dst), m AS (SELECT count(*) AS m FROM edges), d AS (SELECT community, sum(i) AS inside, sum(o) AS outside FROM (SELECT a AS community, CASE WHEN a = c THEN 1 ELSE 0 END AS i, CASE WHEN a IS DISTINCT FROM c THEN 1 ELSE 0 END AS o FROM t UNION ALL SELECT c, 0, CASE WHEN a IS DISTINCT FROM c THEN 1 ELSE 0 END FROM t) WHERE community IS NOT NULL GROUP BY 1) SELECT round(sum(inside / m - pow((2 * inside + outside) / (2 * m), 2)), 9) AS modularity FROM d, m")
def modularity(spark, sf_dir):
    own = graphs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return ms.modularity(graphs.g12(spark, sf_dir), own)


_TWO = f"whole AS (SELECT DISTINCT {sql._ENDS} {sql._LINES} WHERE {sql._12}), e2 AS (SELECT * FROM whole), e1 AS (SELECT * FROM whole WHERE {sql.draw('src', 'dst', 20)} % 20 <> 0)"


@query(f"WITH {_TWO}, al AS (SELECT DISTINCT u AS n1, CASE WHEN u % 10 = 0 THEN u + 1 ELSE u END AS n2 FROM (SELECT src AS u FROM e1 UNION SELECT dst FROM e1) WHERE u % 10 <> 1), i AS (SELECT least(x.n2, y.n2) AS src, greatest(x.n2, y.n2) AS dst FROM e1 JOIN al x ON x.n1 = src JOIN al y ON y.n1 = dst), t AS (SELECT * FROM e2 WHERE src IN (SELECT n2 FROM al) AND dst IN (SELECT n2 FROM al)), c AS (SELECT (SELECT count(*) FROM i WHERE (src, dst) IN (SELECT (src, dst) FROM t)) AS ea, (SELECT count(*) FROM i) AS e1, (SELECT count(*) FROM t) AS e2) SELECT ea, e1, e2, round(ea / e1, 9) AS ec1, round(ea / e2, 9) AS ec2, round(ea / (e1 + e2 - ea), 9) AS s3 FROM c")
def alignment_scores(spark, sf_dir):
    one, two = graphs.two_networks(spark, sf_dir)
    own = nm.nodes(one).filter("id % 10 <> 1")
    pairs = own.select(F.col("id").alias("n1"), F.when(F.col("id") % 10 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("n2"))
    return ms.alignment_scores(one, two, pairs)


@query(f"WITH {_TWO}, d1 AS (SELECT u, count(*) AS d FROM (SELECT src AS u FROM e1 UNION ALL SELECT dst FROM e1) GROUP BY 1), d2 AS (SELECT u, count(*) AS d FROM (SELECT src AS u FROM e2 UNION ALL SELECT dst FROM e2) GROUP BY 1) SELECT a.d AS deg1, b.d AS deg2, round((a.d + b.d) / ((SELECT max(d) FROM d1) + (SELECT max(d) FROM d2)), 9) AS similarity FROM (SELECT DISTINCT d FROM d1) a, (SELECT DISTINCT d FROM d2) b")
def degree_similarity(spark, sf_dir):
    return ms.degree_similarity(*graphs.two_networks(spark, sf_dir))


def _vectors(edges: DataFrame) -> DataFrame:
    return ms.exact_orbits(edges).select("node", F.array("o0", "o1", "o2", "o3").alias("vector"))


# How many orbits the four orbits of up to three nodes depend on, themselves included.
DEPENDENCIES = [1, 2, 2, 2]


@query(sql.top_pairs(DEPENDENCIES, 100))
def similar_nodes(spark, sf_dir):
    one, two = graphs.two_networks(spark, sf_dir)
    return ms.top_pairs(_vectors(one), _vectors(two), ms.orbit_weights(DEPENDENCIES), 100)


@query(sql.predict(4, 11, 11))
def predicted_edges(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    return ms.predict(en.connected_sets(edges, 4), edges, 4, 11, 11)


@query(lambda: sql.held_out(4, 11, 11, 100))
def held_out_prediction(spark, sf_dir):
    parts = nm.split(graphs.g12(spark, sf_dir), 10, 11)
    train, test = (parts.filter(F.col("part") == p).select("src", "dst") for p in ("train", "test"))
    return ms.hold_out(ms.predict(en.connected_sets(train, 4), train, 4, 11, 11), train, test, 100)


@query("WITH r AS (SELECT l_quantity AS score, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS label FROM lineitem), g AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM r GROUP BY 1), t AS (SELECT sum(p) AS pp, sum(q) AS qq FROM g), c AS (SELECT p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(q * (tp - p / 2) / (pp * qq)), 9) AS auroc, round(sum(p / pp * tp / (tp + fp)), 9) AS average_precision FROM c, t")
def ranking_quality(spark, sf_dir):
    rows = graphs.table(spark, sf_dir, "lineitem")
    return ms.ranking_quality(rows.select(F.col("l_quantity").alias("score"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("label")))


@query(f"WITH {_TWO}, {sql.count_pair(3)} SELECT round(sqrt(sum((a - c) * (a - c))), 6) AS euclidean, round(1 - sum(a * c) / sqrt(sum(a * a) * sum(c * c)), 9) AS kernel, round(avg(CASE WHEN greatest(a, c) > 0 THEN abs(a - c) / greatest(a, c) ELSE 0.0 END), 9) AS senatorial FROM cp")
def count_objectives(spark, sf_dir):
    one, two = (ag.counts(en.connected_sets(g, 3), 3) for g in graphs.two_networks(spark, sf_dir))
    return ms.count_objectives(one, two)


@query(lambda: sql.hamming_objective(4))
def hamming_objective(spark, sf_dir):
    one, two = (ag.counts(en.connected_sets(g, 4), 4) for g in graphs.two_networks(spark, sf_dir))
    return ms.hamming_objective(one, two, 4)


@query(sql.ks(f"{_TWO}, d1 AS (SELECT u, count(*) AS d FROM (SELECT src AS u FROM e1 UNION ALL SELECT dst FROM e1) GROUP BY 1), d2 AS (SELECT u, count(*) AS d FROM (SELECT src AS u FROM e2 UNION ALL SELECT dst FROM e2) GROUP BY 1), v AS (SELECT deg, coalesce(a, 0)::DOUBLE AS a, coalesce(b, 0)::DOUBLE AS b FROM (SELECT d AS deg, count(*) AS a FROM d1 GROUP BY 1) FULL JOIN (SELECT d AS deg, count(*) AS b FROM d2 GROUP BY 1) USING (deg))", "deg"))
def degree_distribution_distance(spark, sf_dir):
    one, two = (nm.degree_distribution(g) for g in graphs.two_networks(spark, sf_dir))
    return ms.distribution_distance(one, two, "deg")


@query("SELECT count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3, round(2 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / cbrt(count(*)), 9) AS bin_width FROM lineitem")
def quartiles(spark, sf_dir):
    return ms.quartiles(graphs.table(spark, sf_dir, "lineitem"), "l_extendedprice")


# ---- cliques


@query(f"WITH {sql.GADJ} SELECT count(*) AS cliques FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst JOIN edges p ON p.src = y.dst JOIN edges q ON q.src = x.dst AND q.dst = p.dst JOIN edges r ON r.src = x.src AND r.dst = p.dst")
def cliques_k4(spark, sf_dir):
    return cq.exact(graphs.gadj(spark, sf_dir), 4)


@query(f"WITH {sql.GADJ}, c AS (SELECT * FROM edges WHERE {sql.draw('src', 1, chr(39) + 'color' + chr(39))} % 3 <> {sql.draw('dst', 1, chr(39) + 'color' + chr(39))} % 3) SELECT count(*) / (6 / 27) AS cliques FROM c x JOIN c y ON x.dst = y.src JOIN c z ON z.src = x.src AND z.dst = y.dst")
def cliques_by_color(spark, sf_dir):
    return cq.color_coding(graphs.gadj(spark, sf_dir), 3)


@query(f"WITH {sql.GADJ}, c AS (SELECT * FROM edges WHERE {sql.draw('src', 'dst', 1)} >= 2147483648) SELECT count(*) / 0.125 AS cliques FROM c x JOIN c y ON x.dst = y.src JOIN c z ON z.src = x.src AND z.dst = y.dst")
def cliques_by_thinning(spark, sf_dir):
    return cq.edge_sampling(graphs.gadj(spark, sf_dir), 3, 0.5)


@query(f"WITH {sql.GADJ}, t AS (SELECT x.src AS a, x.dst AS m, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst), p AS (SELECT a AS src, m AS dst FROM t UNION ALL SELECT m, c FROM t UNION ALL SELECT a, c FROM t), s AS (SELECT src, dst FROM edges WHERE {sql.draw('src', 'dst', 1, chr(39) + 'graft' + chr(39))} < 1073741824) SELECT (SELECT count(*) FROM p WHERE (src, dst) IN (SELECT (src, dst) FROM s)) * (SELECT count(*) FROM edges) / (SELECT count(*) FROM s) / 3 AS cliques")
def cliques_by_edges(spark, sf_dir):
    return cq.graft(graphs.gadj(spark, sf_dir), 3, 0.25)


@query()
def cliques_by_shadow(spark, sf_dir):
    return cq.turan_shadow(graphs.gadj(spark, sf_dir), 4, 2000)


@query(sql.cores("SELECT max(h) AS degeneracy FROM est"))
def degeneracy(spark, sf_dir):
    return gl.degeneracy(graphs.g12(spark, sf_dir))


# ---- samplers


def _estimated(method: str):
    def run(spark, sf_dir):
        edges = graphs.g12(spark, sf_dir)
        return sp.estimate(stash(fs.grow(edges, 4, 200_000, method, 3)), edges, 4, method)

    run.__name__ = f"sampled_{method.lower()}_k4"
    return run


for _method in sp.METHODS:
    query()(_estimated(_method))


@query(sql.accept_reject(3, 200_000))
def sampled_accept_reject_k3(spark, sf_dir):
    rows = sp.accept_reject(graphs.gadj(spark, sf_dir), 3, 200_000, 1)
    return rows.select("sample", F.array_join("nodes", " ").alias("nodes"))


@query()
def sampled_walk_k4(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    rows = stash(sp.walk(edges, 4, 5000, 6).withColumn("sample", F.xxhash64("chain", "step")))
    told = en.induced_gint(rows.select("sample", "nodes"), edges, 4, key="sample").join(rows.select("sample", "multiplier"), "sample")
    return sp.estimate(stash(told), edges, 4, "MCMC")


@query()
def walk_neighbours(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    rows = stash(sp.walk(edges, 4, 2000, 6).withColumn("sample", F.xxhash64("chain", "step")))
    told = ag.classify(en.induced_gint(rows.select("sample", "nodes"), edges, 4, key="sample"), 4)
    return ag.neighbour_distribution(told.select("sample", "ordinal").join(rows, "sample"), 4)


@query()
def sampled_by_joins_k4(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    return sp.estimate(stash(fs.by_joins(edges, 4, 200_000, "EBE", 3, edges.count())), edges, 4, "EBE")


@query()
def sampled_reservoir_k3(spark, sf_dir):
    rows = sp.reservoir(graphs.g12(spark, sf_dir), 3, 500)
    return ag.counts(rows, 3)


@query()
def sampled_edge_cover(spark, sf_dir):
    return ag.counts(sp.edge_cover(graphs.g12(spark, sf_dir), 4, 3), 4)


@query()
def sampled_orbit_degrees_k3(spark, sf_dir):
    return sp.sampled_orbit_degrees(fs.grow(graphs.g12(spark, sf_dir), 3, 50_000, "NBE"), 3, "NBE")


@query()
def precision_stop_k3(spark, sf_dir):
    told, batches = sp.until_precise(graphs.g12(spark, sf_dir), 3, "EBE", 2000, 0.5, most=5)
    return told.withColumn("taken", F.lit(batches))


# ---- indexes and seeds


def _index(edges: DataFrame, k: int, top: int = 1, most: int = 4) -> DataFrame:
    heur = nm.degrees(edges).select("id", F.col("deg").cast("double").alias("heur"))
    return ix.index(edges, heur, k, top, most)


@query()
def index_lines(spark, sf_dir):
    rows = _index(graphs.g12(spark, sf_dir), 4)
    return rows.select("line_no", "key", F.array_join("nodes", " ").alias("nodes"))


@query(sql.expand_sets(4))
def expanded_sets(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    heur = nm.degrees(edges).select("id", F.col("deg").cast("double").alias("heur"))
    return ix.expand(edges, heur, 4, 1).select(F.array_join(F.array_sort("nodes"), " ").alias("nodes"))


@query()
def index_patches(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    return ix.patches(_index(edges, 4), edges).select("key", F.array_join("nodes", " ").alias("nodes"))


def _networks(spark, sf_dir) -> list[DataFrame]:
    """The two networks, written as seeds and searches read them many times."""
    return [stash(g) for g in graphs.two_networks(spark, sf_dir)]


def _seeds(spark, sf_dir, networks: list[DataFrame] | None = None) -> DataFrame:
    one, two = networks or graphs.two_networks(spark, sf_dir)
    return stash(ix.seeds(*(ix.patches(stash(_index(g, 4)), g) for g in (one, two))))


@query()
def alignment_seeds(spark, sf_dir):
    return _seeds(spark, sf_dir).select("key", F.array_join("nodes1", " ").alias("nodes1"), F.array_join("nodes2", " ").alias("nodes2"))


@query()
def seed_node_pairs(spark, sf_dir):
    return ix.node_pairs(_seeds(spark, sf_dir))


@query()
def seed_metrics(spark, sf_dir):
    own = nm.nodes(graphs.g12(spark, sf_dir)).select(F.col("id").alias("n1"), F.col("id").alias("n2"))
    return ix.seed_metrics(_seeds(spark, sf_dir), own)


@query(f"WITH {sql.G12}, {sql.classified(4)}, k AS (SELECT s FROM cls WHERE ordinal = 9) SELECT node, count(*) AS count FROM (SELECT unnest(s) AS node FROM k) GROUP BY 1")
def node_frequency(spark, sf_dir):
    sets = ag.classify(en.connected_sets(graphs.g12(spark, sf_dir), 4), 4)
    return ix.node_frequency(sets.filter("ordinal = 9"))


# ---- windows


def _windows(spark, sf_dir) -> DataFrame:
    return stash(fs.grow(graphs.g12(spark, sf_dir), 6, 500, "NBE", 5).select(F.col("sample").alias("window"), F.array_sort("nodes").alias("nodes")))


@query()
def window_frequency(spark, sf_dir):
    return wi.frequency(wi.window_sets(_windows(spark, sf_dir), graphs.g12(spark, sf_dir), 6, 4))


@query()
def window_representatives(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    found = stash(wi.window_sets(_windows(spark, sf_dir), edges, 6, 4))
    parts = [wi.frequency(wi.representatives(found, 4, m)).withColumn("mode", F.lit(m)) for m in wi.MODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query()
def window_limited(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    found = stash(wi.window_sets(_windows(spark, sf_dir), edges, 6, 4))
    return wi.limited(found, edges, "EDGE", 2).select("window", F.array_join("nodes", " ").alias("nodes"), "ordinal")


@query()
def window_by_degree(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    rows = wi.by_degree(edges, 5, nm.nodes(edges))
    return rows.select("window", F.array_join("nodes", " ").alias("nodes"))


# ---- searches step by step, on a graph of bounded size


@query()
def grown_clusters(spark, sf_dir):
    edges = graphs.gadj(spark, sf_dir)
    own = stash(ag.communities(en.connected_sets(edges, 3), 3, by_orbit=False, symmetric=True))
    return lo.clusters(edges, own, 0.7).select("cluster", "n", "m", F.round("density", 9).alias("density"), F.array_join("nodes", " ").alias("nodes"))


def _brand_clusters(spark, sf_dir) -> DataFrame:
    """Brands and types as clusters of parts that overlap."""
    part = graphs.table(spark, sf_dir, "part")
    one = part.select(F.concat(F.lit("b"), "p_brand").alias("c"), "p_partkey")
    two = part.select(F.concat(F.lit("s"), F.col("p_size")).alias("c"), "p_partkey")
    sized = one.union(two).groupBy("c").agg(F.sort_array(F.collect_set("p_partkey")).alias("nodes"))
    return stash(sized.select(F.xxhash64("c").alias("cluster"), "nodes"))


@query("WITH c AS (SELECT 'b' || p_brand AS c, p_partkey AS p FROM part UNION ALL SELECT 's' || p_size, p_partkey FROM part), o AS (SELECT a.c AS x, b.c AS y, count(*) AS common FROM c a JOIN c b ON a.p = b.p AND a.c < b.c GROUP BY 1, 2) SELECT common, count(*) AS pairs FROM o GROUP BY 1")
def cluster_overlaps(spark, sf_dir):
    return lo.overlaps(_brand_clusters(spark, sf_dir)).groupBy("common").agg(F.count("*").alias("pairs"))


@query()
def merged_clusters(spark, sf_dir):
    rows = lo.merge_clusters(_brand_clusters(spark, sf_dir), graphs.g12(spark, sf_dir), 0.1)
    return rows.select(F.array_join("nodes", " ").alias("nodes"), "m")


@query()
def selected_clusters(spark, sf_dir):
    edges = stash(graphs.gadj(spark, sf_dir))
    own = stash(ms.triple_communities(edges))
    return lo.select_clusters(stash(lo.clusters(edges, own, 0.7)), 0.2, 1.0, "EDN")


@query("WITH a AS (SELECT p_partkey AS node, p_type AS term FROM part), c AS (SELECT 'b' || p_brand AS c, p_partkey AS node FROM part UNION SELECT 's' || p_size, p_partkey FROM part), h AS (SELECT c, term, count(*) AS hits FROM c JOIN a USING (node) GROUP BY 1, 2), z AS (SELECT c, count(*) AS size FROM c GROUP BY 1), k AS (SELECT term, count(*) AS carriers FROM a GROUP BY 1) SELECT term, hits, size, carriers, (SELECT count(*) FROM part) AS total, count(*) AS clusters FROM h JOIN z USING (c) JOIN k USING (term) GROUP BY ALL")
def term_enrichment(spark, sf_dir):
    own = graphs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("term"))
    rows = ms.enrichment(_brand_clusters(spark, sf_dir), own)
    return rows.groupBy("term", "hits", "size", "carriers", "total").agg(F.count("*").alias("clusters"))


@query()
def all_alignments(spark, sf_dir):
    one, two = own = _networks(spark, sf_dir)
    return lo.align_all(one, two, _seeds(spark, sf_dir, own), least_ec=0.9, most=5)


@query()
def optimised_partition(spark, sf_dir):
    return lo.optimise_partition(graphs.g12(spark, sf_dir), 10)


@query()
def grown_alignments(spark, sf_dir):
    one, two = own = _networks(spark, sf_dir)
    return lo.align(one, two, _seeds(spark, sf_dir, own), least_ec=0.6, most=40)


@query()
def rewired_graph(spark, sf_dir):
    return lo.rewire(graphs.g12(spark, sf_dir), {"triangles": 50.0}, lo.triangle_measure, 60, stagnation=60)


@query()
def stamped_graph(spark, sf_dir):
    return lo.stamped(spark, graphs.g12(spark, sf_dir), 300, 600, 5)


@query()
def global_measures(spark, sf_dir):
    return lo.global_measures(graphs.g12(spark, sf_dir))


@query("SELECT * FROM (SELECT '1' AS feature, round(regr_intercept(l_extendedprice, l_quantity), 6) AS weight FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 6) FROM lineitem)")
def linear_fit(spark, sf_dir):
    return lo.fit_linear(graphs.table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice").withColumn("weight", F.round("weight", 6))


# ---- catalogs


@query(f"SELECT * FROM {sql.values([(g, sql.minimum(g, 4)) for g in range(64)], 'gint, canonical', 'x')}")
def canonical_map_k4(spark, sf_dir):
    own = catalogs.canon_map(spark, 4).join(catalogs.canon(spark, 4).select("ordinal", F.col("gint").alias("canonical")), "ordinal")
    return own.select("gint", "canonical")


def _catalog(name: str, make, oracle=None):
    def run(spark, sf_dir):
        return make(spark)

    run.__name__ = name
    query(oracle)(run)


for _name, _make, _sql in (
    ("catalog_k5", lambda s: catalogs.canon(s, 5).withColumn("orbits", F.array_join("orbits", " ")), lambda: sql.plain_catalog(5)),
    ("catalog_directed_k4", lambda s: catalogs.canon(s, 4, True).withColumn("orbits", F.array_join("orbits", " ")), None),
    ("canonical_map_k5", lambda s: catalogs.canon_map(s, 5).join(catalogs.canon(s, 5).select("ordinal", F.col("gint").alias("canonical")), "ordinal").select("gint", "canonical"), lambda: sql.plain_map(5)),
    ("catalog_orbits_k5", lambda s: catalogs.orbits(s, 5), lambda: sql.plain_orbits(5)),
    ("catalog_alphas_k5", lambda s: catalogs.alphas(s, 5, "EBE"), lambda: sql.plain_alphas(5)),
    ("catalog_subcanonicals_k5", lambda s: catalogs.subcanon(s, 5), lambda: sql.plain_subcanonicals(5)),
    ("catalog_hamming_k5", lambda s: catalogs.hamming(s, 5), lambda: sql._table(sql.plain_distances(5), "c1, c2, dist")),
    ("hamming_neighbours_k5", lambda s: catalogs.hamming_neighbours(s, 5, 2), lambda: sql._table([(a, b) for a, b, d in sql.plain_distances(5) if d == 2], "c1, c2")),
    ("catalog_crosswalk_k5", lambda s: catalogs.crosswalk(s, 5), lambda: sql.plain_crosswalk(5)),
    ("catalog_minimal_chains_k5", lambda s: catalogs.minimal_chains(s, 5), lambda: sql.plain_chains(5)),
    ("catalog_directed_totals", catalogs.directed_totals, lambda: sql.plain_directed_totals()),
    ("catalog_report_k4", lambda s: catalogs.report(s, 4), lambda: sql.plain_report(4)),
    ("catalog_drawings_k4", lambda s: catalogs.dot(s, 4), lambda: sql.plain_drawings(4)),
    ("catalog_unambiguous_k5", lambda s: ag.unambiguous(s, 5, 4), lambda: sql.plain_unambiguous(5, 4)),
    ("chained_canonicals_k5", lambda s: nm.clean(nm.chained_canonicals(s, 5)), lambda: sql.plain_chained(5)),
    ("map_differences_k4", lambda s: catalogs.map_differences(catalogs.canon_map(s, 4), catalogs.canon_map(s, 4).withColumn("ordinal", F.when(F.col("gint") == 5, 0).otherwise(F.col("ordinal"))), catalogs.orbits(s, 4)), "SELECT 5::BIGINT AS gint"),
):
    _catalog(_name, _make, _sql)


@query(lambda: sql.plain_map(5))
def canonicalize_udf(spark, sf_dir):
    udfs.register(spark)
    spark.range(1 << 10).createOrReplaceTempView("graph_numbers")
    return spark.sql("SELECT id AS gint, canonicalize(id, 5).canonical AS canonical FROM graph_numbers")


@query()
def sampled_by_table_function(spark, sf_dir):
    udfs.register(spark)
    graphs.g12(spark, sf_dir).createOrReplaceTempView("graph_edges")
    rows = spark.sql("SELECT * FROM sample_graphlets(TABLE(graph_edges) WITH SINGLE PARTITION, 4, 5000, 'EBE')")
    return ag.counts(rows, 4)


# ---- text files, written and read again


def _written(rows: DataFrame, ending: str, **options) -> str:
    """The path of lines (value), written as text."""
    path = f"{shared_folder(rows.sparkSession)}/text-{uuid.uuid4().hex}{ending}"
    rows.select("value").write.options(**options).text(path)
    return path


_G12_TEXT = f"WITH {sql.G12} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM edges"


def _file_query(name: str, write, read) -> None:
    def run(spark, sf_dir):
        return read(spark, write(graphs.g12(spark, sf_dir)))

    run.__name__ = name
    query(_G12_TEXT)(run)


def _spaced(*columns: str, sep: str = " "):
    return F.concat_ws(sep, *(F.col(c).cast("string") for c in columns)).alias("value")


def _as_leda(edges: DataFrame) -> DataFrame:
    """The lines of one file, in order: head, nodes, edges by the nodes' numbers."""
    own = nm.numbered(nm.nodes(edges), "id")
    at = lambda c: own.select(F.col("id").alias(c), (F.col("no") + 1).alias(f"{c}_no"))
    head = edges.sparkSession.createDataFrame([(0, 0, t) for t in ("LEDA.GRAPH", "string", "short", "-2")], "part int, at long, value string")
    nodes = own.select(F.lit(1).alias("part"), F.col("no").alias("at"), F.format_string("|{%s}|", F.col("id").cast("string")).alias("value"))
    ends = edges.join(at("src"), "src").join(at("dst"), "dst").select(
        F.lit(2).alias("part"), F.col("src").alias("at"), F.concat(_spaced("src_no", "dst_no"), F.lit(" 0 |{}|")).alias("value")
    )
    return head.union(nodes).union(ends).coalesce(1).sortWithinPartitions("part", "at")


for _name, _write, _read in (
    ("read_edge_list", lambda e: _written(e.select(_spaced("src", "dst")), ".el"), formats.read),
    ("read_edge_list_gz", lambda e: _written(e.select(_spaced("src", "dst", sep="\t")), ".txt.gz", compression="gzip"), formats.read),
    ("read_edge_list_bz2", lambda e: _written(e.select(_spaced("src", "dst")), ".el.bz2", compression="bzip2"), formats.read),
    ("read_csv", lambda e: _written(e.select(_spaced("src", "dst", sep=";")), ".csv"), formats.read),
    ("read_lgf", lambda e: _written(e.select(F.concat(_spaced("src", "dst"), F.lit(" 0 1")).alias("value")), ".lgf"), formats.read),
    ("read_graphml", lambda e: _written(e.select(F.format_string('<edge source="%d" target="%d"/>', "src", "dst").alias("value")), ".graphml"), formats.read),
    ("read_gml", lambda e: _written(e.select(F.format_string("edge [\n source %d\n target %d\n ]", "src", "dst").alias("value")), ".gml"), formats.read),
    ("read_leda", lambda e: _written(_as_leda(e), ".gw"), formats.read),
):
    _file_query(_name, _write, _read)


@query(f"WITH {sql.G12} SELECT src, dst FROM edges")
def read_checked(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    top = edges.agg(F.max("dst"), F.count("*")).first()
    head = spark.createDataFrame([(0, f"{top[0] + 1} {top[1]}")], "at int, value string")
    lines = head.union(edges.select(F.lit(1), _spaced("src", "dst"))).coalesce(1).sortWithinPartitions("at")
    return formats.checked(spark, _written(lines, ".txt"))


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE p_size <= 10 AND p_partkey IN (WITH " + sql.G12 + ", " + sql.BOTH + " SELECT u FROM b)")
def read_interest(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    part = graphs.table(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("id"))
    path = _written(part.join(nm.nodes(edges), "id", "left_semi").select(_spaced("id")), ".txt")
    return formats.interest(spark, path, edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))


@query("SELECT p_partkey::VARCHAR AS id, p_size::DOUBLE AS weight FROM part")
def read_importance(spark, sf_dir):
    return formats.importance(spark, _written(graphs.table(spark, sf_dir, "part").select(_spaced("p_partkey", "p_size")), ".txt"))


@query(f"WITH {sql.G12}, {sql.BOTH} SELECT u::VARCHAR AS id, count(*)::DOUBLE AS heur FROM b GROUP BY u")
def read_orbit_vectors(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    rows = ms.exact_orbits(edges)
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}.odv"
    sinks.vectors(rows, path)
    return formats.orbit_value(formats.orbit_vectors(spark, path), nm.nodes(edges).select(F.col("id").cast("string").alias("id")), 0)


@query(f"WITH {sql.G12}, {sql.classified(3)} SELECT ordinal::VARCHAR AS key, array_to_string(list_transform(perm, lambda p: s[p + 1]), ' ') AS nodes FROM cls")
def read_index(spark, sf_dir):
    rows = ag.index_rows(en.sort_sets(en.connected_sets(graphs.g12(spark, sf_dir), 3), 3), 3)
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}.index"
    sinks.index(rows, path)
    return formats.index_lines(spark, path, 3).select("key", F.array_join("nodes", " ").alias("nodes"))


_SEED_LINES = "SELECT 's' || s_suppkey AS key, s_suppkey || ',' || s_nationkey AS nodes1, s_nationkey || ',' || s_suppkey AS nodes2"


def _seed_rows(spark, sf_dir) -> DataFrame:
    own = graphs.table(spark, sf_dir, "supplier")
    two = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    return own.select(F.concat(F.lit("s"), "s_suppkey").alias("key"), two("s_suppkey", "s_nationkey").alias("a"), two("s_nationkey", "s_suppkey").alias("b"), "s_nationkey")


@query(f"{_SEED_LINES} FROM supplier")
def read_seeds(spark, sf_dir):
    rows = formats.seeds(spark, _written(_seed_rows(spark, sf_dir).select(_spaced("key", "a", "b")), ".seeds"))
    return rows.select("key", F.array_join("nodes1", ",").alias("nodes1"), F.array_join("nodes2", ",").alias("nodes2"))


@query(f"{_SEED_LINES}, s_nationkey::DOUBLE AS similarity, min(r) OVER (PARTITION BY s_nationkey) AS first, count(*) OVER (PARTITION BY s_nationkey) AS alike FROM (SELECT *, row_number() OVER (ORDER BY s_nationkey DESC) - 1 AS r FROM supplier)")
def read_ranked_seeds(spark, sf_dir):
    rows = formats.ranked_seeds(spark, _written(_seed_rows(spark, sf_dir).select(_spaced("key", "a", "b", "s_nationkey")), ".seeds"))
    tied = rows.groupBy("similarity").agg(F.min("place").alias("first"), F.count("*").alias("alike"))
    return rows.join(tied, "similarity").select("key", F.array_join("nodes1", ",").alias("nodes1"), F.array_join("nodes2", ",").alias("nodes2"), "similarity", "first", "alike")


@query("SELECT s_suppkey::VARCHAR AS n1, s_nationkey::VARCHAR AS n2 FROM supplier WHERE s_suppkey <> 0 AND s_nationkey <> 0")
def read_orthologs(spark, sf_dir):
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}.tsv"
    graphs.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name").write.csv(path, sep="\t", header=True)
    return formats.orthologs(spark, path, "s_suppkey", "s_nationkey")


@query("SELECT s_suppkey::VARCHAR AS n1, s_nationkey::VARCHAR AS n2, s_acctbal AS similarity FROM supplier")
def read_similarities(spark, sf_dir):
    rows = graphs.table(spark, sf_dir, "supplier").select(_spaced("s_suppkey", "s_nationkey", "s_acctbal"))
    return formats.similarities(spark, _written(rows, ".sim"))


@query("SELECT count(*)::BIGINT AS n, 5::BIGINT AS m, 0.5::DOUBLE AS density, string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_partkey) AS nodes FROM part GROUP BY p_brand")
def read_clusters(spark, sf_dir):
    own = graphs.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list("p_partkey")).alias("nodes"))
    found = own.select(F.size("nodes").cast("long").alias("n"), F.lit(5).cast("long").alias("m"), F.lit(0.5).alias("density"), "nodes")
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}.clusters"
    sinks.lines(lo.cluster_lines(found), path)
    return formats.clusters(spark, path).select("n", "m", "density", F.array_join("nodes", " ").alias("nodes"))


@query("SELECT p_partkey::VARCHAR AS node, count(*) OVER (PARTITION BY CASE WHEN p_size > 40 THEN '' ELSE p_brand END) AS size FROM part")
def read_partition(spark, sf_dir):
    part = graphs.table(spark, sf_dir, "part")
    listed = part.filter("p_size <= 40").groupBy("p_brand").agg(F.collect_list(F.col("p_partkey").cast("string")).alias("nodes"))
    path = _written(listed.select(F.array_join("nodes", " ").alias("value")), ".parts")
    rows = formats.partition(spark, path, part.select(F.col("p_partkey").cast("string").alias("id")))
    size = rows.groupBy("community").agg(F.count("*").alias("size"))
    return rows.join(size, "community").select("node", "size")


@query(sql.predict(4, 11, 11).replace("SELECT u, v, round", "SELECT u::VARCHAR AS u, v::VARCHAR AS v, round"))
def read_predictions(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}.tsv"
    sinks.predictions(ms.predict(en.connected_sets(edges, 4), edges, 4, 11, 11), path)
    return formats.predictions(spark, path)


@query(lambda: sql.plain_orbits(4))
def stored_catalog(spark, sf_dir):
    path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    sinks.catalog(catalogs.orbits(spark, 4).withColumn("k", F.lit(4)), path)
    return spark.read.parquet(path).drop("k")


# ---- more walks


@query()
def walks_from_all_edges(spark, sf_dir):
    edges = graphs.g12(spark, sf_dir)
    rows = stash(sp.walk_from_all(edges, 4, 4).withColumn("sample", F.xxhash64("chain", "step")))
    told = en.induced_gint(rows.select("sample", "nodes"), edges, 4, key="sample").join(rows.select("sample", "multiplier"), "sample")
    return sp.estimate(stash(told), edges, 4, "MCMC")


@query()
def window_walks(spark, sf_dir):
    return sp.window_walk(graphs.g12(spark, sf_dir), 6, 500, 12).select("window", F.array_join("nodes", " ").alias("nodes"))


@query()
def index_lines_k6(spark, sf_dir):
    rows = _index(graphs.g12(spark, sf_dir), 6)
    return rows.select("line_no", "key", F.array_join("nodes", " ").alias("nodes"))


@query()
def alignments_merged_over_a_floor(spark, sf_dir):
    one, two = graphs.two_networks(spark, sf_dir)
    found = stash(lo.align_all(one, two, _seeds(spark, sf_dir), least_ec=0.9, most=2, size=8))
    return lo.merge_with_floor(one, two, found, 0.5)


@query()
def rewired_towards(spark, sf_dir):
    one, two = graphs.two_networks(spark, sf_dir)
    return lo.rewire_towards(one, two, dict.fromkeys(lo.OBJECTIVES, 1.0), 20, stagnation=20)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: told if isinstance(told, str) else told() for name, told in ORACLE.items()}
