"""Sampled graphlets. Every choice is a draw on (seed, sample, step), so results do not depend on partitions or retries.

The growing samplers take one join with the adjacency lists per node; nothing of the graph is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphlets
from ..functions.draws import SPAN, below, draw
from ..plans import catalogs
from . import aggregate as ag
from .enumerate import bits_of, induced_gint
from .graph_loops import components
from .normalize import adjacency, nodes, numbered

METHODS = ("NBE", "EBE", "PLAIN")


def component_shares(edges: DataFrame, k: int) -> DataFrame:
    """(cc, size, share, upto): components of k nodes or more, their share of all sets of k nodes of one component, and the sum
    of shares up to theirs, by falling size."""
    sizes = components(edges).groupBy("cc").agg(F.count("*").alias("size")).filter(F.col("size") >= k)
    ways = reduce(lambda a, b: a * b, [(F.col("size") - i).cast("double") for i in range(k)])
    weighed = sizes.withColumn("ways", ways)
    whole = weighed.agg(F.sum("ways").alias("all"))
    shared = weighed.join(F.broadcast(whole)).withColumn("share", F.col("ways") / F.col("all"))
    # large components are few: sizes that are equal share one row of the running sum
    by_size = shared.groupBy("size").agg(F.sum("share").alias("s"))
    ahead = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)  # one row per different size
    before = by_size.select("size", F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("before"))
    # the place among components of the same size, however many there are
    ranked = numbered(shared.withColumn("neg", -F.col("size")), "neg", "cc")
    first = ranked.groupBy("size").agg(F.min("no").alias("first"))
    own = ranked.join(F.broadcast(before), "size").join(F.broadcast(first), "size")
    placed = own.withColumn("upto", F.col("before") + (F.col("no") - F.col("first") + 1) * F.col("share"))
    return placed.select("cc", "size", F.round("share", 9).alias("share"), F.round("upto", 9).alias("upto"))


def start_edges(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """(sample, u, v): n edges by chance, each in a direction by chance. The same edge may come again."""
    own = numbered(edges.select("src", "dst"), "src", "dst")
    m = own.count()
    drawn = edges.sparkSession.range(n).select(F.col("id").alias("sample"), below(F.lit(max(1, m)), seed, F.col("id"), "edge").alias("no"))
    turned = draw(seed, F.col("sample"), "turn") % 2 == 0
    pick = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    return drawn.join(own, "no").select("sample", pick("src", "dst").alias("u"), pick("dst", "src").alias("v"))


def _merge(cands: Column, near: Column, members: Column, bit: int) -> Column:
    """Candidates after a member with these neighbours came in: masks of known ones get its bit, others are added."""
    old = F.transform(
        cands, lambda c: F.struct(c["v"].alias("v"), F.when(F.array_contains(near, c["v"]), c["m"] + bit).otherwise(c["m"]).alias("m"))
    )
    known = F.concat(F.transform(cands, lambda c: c["v"]), members)
    fresh = F.transform(F.array_except(near, known), lambda x: F.struct(x.alias("v"), F.lit(bit).alias("m")))
    return F.concat(old, fresh)


def grow(edges: DataFrame, k: int, n: int, method: str = "EBE", seed: int = 1, starts: DataFrame | None = None) -> DataFrame:
    """(sample, nodes, gint, multiplier) of n samples, nodes in the order in which they joined.

    From an edge by chance a sample takes a neighbour at a time: NBE and PLAIN each with equal chance, EBE in proportion to
    the edges that lead to it. multiplier is the inverse of the chance of what was taken (1 for PLAIN). Samples whose
    component has fewer than k nodes are left out. starts(sample, u, v) replaces the edges by chance.
    """
    if method not in METHODS:
        raise ValueError(f"{method} is none of {METHODS}")
    lists = adjacency(edges).select(F.col("id").alias("w"), "nbrs")
    first = starts if starts is not None else start_edges(edges, n, seed)
    none = F.array().cast("array<struct<v: bigint, m: int>>")
    one = first.join(lists, F.col("u") == F.col("w")).select("sample", "u", "v", F.col("nbrs").alias("nu"))
    rows = one.join(lists, F.col("v") == F.col("w")).select(
        "sample", F.array("u", "v").alias("nodes"), bits_of(F.lit(1), 1, k).alias("gint"), F.lit(1.0).alias("multiplier"), "nu", "nbrs"
    )
    rows = rows.withColumn("cands", _merge(none, F.col("nu"), F.col("nodes"), 1)).withColumn(
        "cands", _merge(F.col("cands"), F.col("nbrs"), F.col("nodes"), 2)
    )
    rows = rows.select("sample", "nodes", "gint", "multiplier", "cands")
    for p in range(2, k):
        rows = rows.filter(F.size("cands") > 0)
        if method == "EBE":
            total = F.aggregate("cands", F.lit(0), lambda s, c: s + F.bit_count(c["m"]))
            rows = rows.withColumn("total", total).withColumn("hit", below(F.col("total"), seed, F.col("sample"), p))
            total = F.col("total")
            passed = lambda s, c: s["sum"] + F.bit_count(c["m"])
            at = F.aggregate(
                "cands",
                F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")),
                lambda s, c: F.struct(passed(s, c).alias("sum"), (s["at"] + (passed(s, c) <= F.col("hit")).cast("int")).alias("at")),
                lambda s: s["at"],
            )
        else:
            total = F.size("cands")
            at = below(total, seed, F.col("sample"), p)
        factor = F.lit(1.0) if method == "PLAIN" else total.cast("double")
        rows = rows.select("sample", "nodes", "gint", (F.col("multiplier") * factor).alias("multiplier"), "cands", F.get("cands", at.cast("int")).alias("new"))
        rows = rows.select(
            "sample",
            F.concat("nodes", F.array("new.v")).alias("nodes"),
            (F.col("gint") + bits_of(F.col("new.m"), p, k)).alias("gint"),
            "multiplier",
            F.filter("cands", lambda c: c["v"] != F.col("new.v")).alias("cands"),
            F.col("new.v").alias("w"),
        )
        if p < k - 1:
            joined = rows.join(lists, "w").withColumn("cands", _merge(F.col("cands"), F.col("nbrs"), F.col("nodes"), 1 << p))
            rows = joined.select("sample", "nodes", "gint", "multiplier", "cands")
    return rows.select("sample", "nodes", "gint", "multiplier")


def accept_reject(edges: DataFrame, k: int, n: int, seed: int = 1) -> DataFrame:
    """(sample, nodes, gint): of n sets of k nodes by chance those that hang together; every connected set is as likely as
    any other. In sparse graphs few are."""
    own = numbered(nodes(edges), "id")
    count = own.count()
    tries = edges.sparkSession.range(n).select(
        F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")
    )
    drawn = tries.withColumn("no", below(F.lit(max(1, count)), seed, F.col("sample"), F.col("i")))
    sets = drawn.join(own, "no").groupBy(F.col("sample")).agg(F.sort_array(F.collect_set("id")).alias("nodes"))
    whole = sets.filter(F.size("nodes") == k)
    told = induced_gint(whole, edges, k, key="sample")
    fine = catalogs.canon_map(edges.sparkSession, k).join(
        catalogs.canon(edges.sparkSession, k).filter("connected").select("ordinal"), "ordinal", "left_semi"
    )
    return told.join(F.broadcast(fine.select("gint")), "gint", "left_semi").select("sample", "nodes", "gint")


def walk(edges: DataFrame, k: int, chains: int, steps: int, seed: int = 1, starts: DataFrame | None = None) -> DataFrame:
    """(chain, step, nodes, multiplier): what chains of steps over edges hold in their last k - 1 edges, whenever these
    have k different nodes. A step swaps one end of the edge for a neighbour of the other, each neighbouring edge being as likely.
    starts(sample, u, v) replaces the edges by chance.
    multiplier is the product, over the inner edges of the stretch, of the number of neighbouring edges (1 / it if there is
    one inner edge or none)."""
    lists = adjacency(edges).select(F.col("id").alias("w"), "nbrs")
    at = (start_edges(edges, chains, seed) if starts is None else starts).withColumnRenamed("sample", "chain")
    at = at.join(lists, F.col("u") == F.col("w")).select("chain", "u", "v", F.col("nbrs").alias("nu"))
    at = at.join(lists, F.col("v") == F.col("w")).select("chain", "u", "v", "nu", F.col("nbrs").alias("nv"))
    edge = lambda u, v, d: F.struct(u.alias("u"), v.alias("v"), d.cast("double").alias("d"))
    choices = F.size("nu") + F.size("nv") - 2
    at = at.withColumn("last", F.array(edge(F.col("u"), F.col("v"), choices)))
    out = at.select("chain", F.lit(0).alias("step"), "last")
    for t in range(1, steps + 1):
        live = at.filter(choices > 0)
        hit = below(choices, seed, F.col("chain"), "step", t)
        at_u = hit < F.size("nu") - 1
        others = F.when(at_u, F.array_remove("nu", F.col("v"))).otherwise(F.array_remove("nv", F.col("u")))
        place = F.when(at_u, hit).otherwise(hit - (F.size("nu") - 1)).cast("int")
        moved = live.select(
            "chain",
            F.when(at_u, F.col("u")).otherwise(F.col("v")).alias("u"),
            F.get(others, place).alias("v"),
            F.when(at_u, F.col("nu")).otherwise(F.col("nv")).alias("nu"),
            "last",
        )
        at = moved.join(lists, F.col("v") == F.col("w")).select("chain", "u", "v", "nu", F.col("nbrs").alias("nv"), "last")
        grown = F.concat("last", F.array(edge(F.col("u"), F.col("v"), choices)))
        at = at.withColumn("last", F.slice(grown, F.greatest(F.size(grown) - (k - 2), F.lit(1)), F.lit(k - 1)))
        out = out.union(at.select("chain", F.lit(t).alias("step"), "last"))
    seen = F.array_sort(F.array_distinct(F.flatten(F.transform("last", lambda e: F.array(e["u"], e["v"])))))
    inner = F.aggregate(F.slice("last", 2, max(1, k - 3)), F.lit(1.0), lambda s, e: s * e["d"]) if k > 3 else F.lit(1.0)
    held = out.withColumn("nodes", seen).filter((F.size("nodes") == k) & (F.size("last") == k - 1))
    return held.select("chain", "step", "nodes", inner.alias("multiplier"))


def walk_from_all(edges: DataFrame, k: int, steps: int, seed: int = 1) -> DataFrame:
    """As :func:`walk`, with a chain from every edge: chains are numbered by the edges' order, and which end comes first is by chance."""
    own = numbered(edges.select("src", "dst"), "src", "dst")
    turned = draw(seed, F.col("no"), "turn") % 2 == 0
    pick = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    return walk(edges, k, 0, steps, seed, own.select(F.col("no").alias("sample"), pick("src", "dst").alias("u"), pick("dst", "src").alias("v")))


def window_walk(edges: DataFrame, w: int, chains: int, steps: int, seed: int = 1) -> DataFrame:
    """(window, nodes): walks from node to node until they have come by w different nodes; those are a window, and the walk goes on
    with the later half of its steps. window is the chain's number times the steps, and the step."""
    from ..plans.stash import stash

    lists = adjacency(edges).select(F.col("id").alias("at"), "nbrs")
    state = start_edges(edges, chains, seed).select(F.col("sample").alias("chain"), F.array("u", "v").alias("trail"), F.col("v").alias("at"))
    out = None
    for t in range(1, steps + 1):
        moved = state.join(lists, "at").withColumn("to", F.get("nbrs", below(F.size("nbrs"), seed, F.col("chain"), "window", t).cast("int")))
        moved = stash(moved.select("chain", F.concat("trail", F.array("to")).alias("trail"), F.col("to").alias("at")))
        done = F.size(F.array_distinct("trail")) == w
        full = moved.filter(done).select((F.col("chain") * (steps + 1) + t).alias("window"), F.array_sort(F.array_distinct("trail")).alias("nodes"))
        out = full if out is None else out.union(full)
        later = F.slice("trail", F.floor(F.size("trail") / 2).cast("int") + 1, F.size("trail"))
        state = moved.withColumn("trail", F.when(done, later).otherwise(F.col("trail")))
    return out


def near_top(rows: DataFrame, score: str, delta: float, *key: str, seed: int = 1) -> DataFrame:
    """One of the rows whose score is within delta of the highest, by chance; key names the row."""
    top = rows.agg((F.max(score) - delta).alias("least"))
    fine = rows.join(F.broadcast(top), F.col(score) >= F.col("least")).drop("least")
    return fine.orderBy(draw(seed, *(F.col(c) for c in key)), *key).limit(1)


def edge_cover(edges: DataFrame, k: int, rounds: int, seed: int = 1) -> DataFrame:
    """(sample, nodes, gint, multiplier): samples that between them take as many edges as they can. Each round samples from
    edges that no set has taken yet; rounds end when none is left or after ``rounds``."""
    from ..plans.stash import stash

    left, out = stash(edges.select("src", "dst")), None
    for r in range(rounds):
        m = left.count()
        if not m:
            break
        starts = left.select(F.xxhash64("src", "dst", F.lit(r)).alias("sample"), F.col("src").alias("u"), F.col("dst").alias("v"))
        # of sets that share nodes a draw decides; half of the open edges start a set in a round
        chosen = starts.filter(draw(seed, r, F.col("u"), F.col("v")) < SPAN // 2) if m > 1 else starts
        taken = stash(grow(edges, k, 0, "NBE", seed + r, chosen))
        out = taken if out is None else out.union(taken)
        pairs = taken.select(F.explode("nodes").alias("src"), F.col("nodes").alias("all")).select("src", F.explode("all").alias("dst"))
        used = pairs.filter("src < dst").distinct()
        left = stash(left.join(used, ["src", "dst"], "left_anti"))
        stuck = chosen.select(F.col("u").alias("src"), F.col("v").alias("dst")).join(used, ["src", "dst"], "left_anti")
        left = stash(left.join(stuck, ["src", "dst"], "left_anti"))
    return out


def contributions(samples: DataFrame, k: int, method: str, raw: bool = False) -> DataFrame:
    """samples with ordinal, perm and contribution: the multiplier over the ways in which the method builds the graphlet, or 1
    each if raw."""
    classed = ag.classify(samples, k)
    if raw or method == "PLAIN":
        return classed.withColumn("contribution", F.lit(1.0))
    own = catalogs.alphas(samples.sparkSession, k, method)
    return classed.join(F.broadcast(own), "ordinal").withColumn("contribution", F.col("multiplier") / F.col("alpha")).drop("alpha")


def estimate(samples: DataFrame, edges: DataFrame, k: int, method: str, raw: bool = False) -> DataFrame:
    """(ordinal, samples, concentration, count) for every connected graphlet: counts scale shares by the stars that degrees
    tell exactly."""
    told = contributions(samples, k, method, raw)
    found = told.groupBy("ordinal").agg(F.count("*").alias("samples"), F.sum("contribution").alias("c"))
    n = found.agg(F.sum("samples").alias("n"), F.sum("c").alias("all"))
    shared = found.join(F.broadcast(n)).withColumn("concentration", F.col("c") / F.col("all"))
    scale = ag.star_multiplier(edges, shared.select("ordinal", (F.col("concentration") * F.col("n")).alias("count")), k)
    whole = shared.join(F.broadcast(scale.select("multiplier")))
    out = whole.select(
        "ordinal", "samples", F.round("concentration", 9).alias("concentration"), F.round(F.col("concentration") * F.col("n") * F.col("multiplier")).cast("long").alias("count")
    )
    full = ag.with_absent(samples.sparkSession, out, k, "count")
    return full.withColumn("samples", F.coalesce("samples", F.lit(0))).withColumn("concentration", F.coalesce("concentration", F.lit(0.0)))


def sampled_orbit_degrees(samples: DataFrame, k: int, method: str) -> DataFrame:
    """(node, orbit, share): orbit degrees by contribution, all of an orbit's nodes adding up to its share of the graphlet."""
    told = contributions(samples, k, method)
    place = catalogs.orbits(samples.sparkSession, k).select("ordinal", "pos", "orbit")
    at = told.select("ordinal", "nodes", "contribution", F.posexplode("perm").alias("pos", "at"))
    own = at.select("ordinal", "pos", F.expr("nodes[at]").alias("node"), "contribution").join(F.broadcast(place), ["ordinal", "pos"])
    return own.groupBy("node", "orbit").agg(F.round(F.sum("contribution"), 6).alias("share"))


def until_precise(edges: DataFrame, k: int, method: str, batch: int, precision: float, most: int = 50, least: int = 3, worst: bool = False) -> tuple[DataFrame, int]:
    """Batch statistics (see :func:`aggregate.batch_statistics`) once the mean (or worst) relative width over the connected graphlets is
    at most precision, and how many batches that took. What grows with the batches is a row per batch and graphlet."""
    from ..plans.stash import stash

    from .fast_sampling import sampler

    seen, drawn = None, sampler(edges, k, method, often=True)
    for b in range(most):
        own = ag.counts(drawn(batch, 1000 + b), k).select(F.lit(b).alias("batch"), "ordinal", "count")
        seen = stash(own) if seen is None else seen.union(stash(own))
        if b + 1 >= least:
            told = ag.batch_statistics(seen, k)
            width = told.agg((F.max if worst else F.avg)("relative").alias("w")).first()["w"]
            if width <= precision:
                return told, b + 1
    return ag.batch_statistics(seen, k), most


def recent_once(samples: DataFrame) -> DataFrame:
    """samples, each set of nodes once: the one with the smallest sample."""
    keyed = samples.withColumn("__key", F.array_sort("nodes"))
    first = keyed.groupBy("__key").agg(F.min("sample").alias("sample"))
    return keyed.join(first, ["__key", "sample"], "left_semi").drop("__key")


def from_lines(lines: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(sample, nodes, gint) of samples given as lines (value) of k node numbers."""
    from ..plans.stash import stash

    # written once, so that a line keeps its number when a task runs again
    own = stash(lines.select(F.monotonically_increasing_id().alias("sample"), F.split(F.trim("value"), r"\s+").cast("array<bigint>").alias("nodes")))
    return induced_gint(own.filter(F.size("nodes") == k), edges, k, key="sample")


def reservoir(edges: DataFrame, k: int, n: int, seed: int = 1, rounds: int | None = None) -> DataFrame:
    """(sample, nodes, gint): NBE samples that go on to 8 k steps: at step i a neighbour by chance comes in with chance k / i in
    place of a member by chance, if the set still hangs together. Each round is a join; a graph is never gathered."""
    connected = catalogs.canon(edges.sparkSession, k).filter("connected").select("ordinal")
    fine = catalogs.canon_map(edges.sparkSession, k).join(connected, "ordinal", "left_semi").select(F.col("gint").alias("fine"))
    lists = adjacency(edges).select("id", "nbrs")
    rows = grow(edges, k, n, "NBE", seed).select("sample", "nodes", "gint")
    from ..plans.stash import stash

    rows = stash(rows)
    for i in range(k + 1, (rounds + k if rounds is not None else 8 * k) + 1):
        tried = rows.filter(draw(seed, F.col("sample"), i, "try") * i < k * SPAN)
        member = F.get("nodes", below(F.lit(k), seed, F.col("sample"), i, "from").cast("int"))
        out = F.get("nodes", below(F.lit(k), seed, F.col("sample"), i, "out").cast("int"))
        met = tried.withColumn("id", member).withColumn("out", out).join(lists, "id")
        free = F.array_except("nbrs", "nodes")
        new = F.get(free, below(F.greatest(F.size(free), F.lit(1)), seed, F.col("sample"), i, "in").cast("int"))
        swapped = met.withColumn("new", new).filter("new is not null").select(
            "sample", F.array_sort(F.concat(F.filter("nodes", lambda x: x != F.col("out")), F.array("new"))).alias("nodes")
        )
        told = induced_gint(swapped, edges, k, key="sample")
        good = told.join(F.broadcast(fine), F.col("gint") == F.col("fine"), "left_semi")
        rows = stash(rows.join(good.select("sample"), "sample", "left_anti").unionByName(good.select("sample", "nodes", "gint")))
    return rows
