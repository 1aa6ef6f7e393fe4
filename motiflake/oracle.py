"""DuckDB SQL for the engine's queries: graphs as common table expressions, sets of k nodes by growth and DISTINCT, classes by
literal tables of at most 1,024 rows. Written apart from the engine's own plans, to hold them against."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from math import factorial

from .functions import graphlets

_LINES = "FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey"
_ENDS = "least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst"
_12 = "a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey"
G12 = f"edges AS (SELECT DISTINCT {_ENDS} {_LINES} WHERE {_12})"
G12W = f"edges AS (SELECT {_ENDS}, count(*)::DOUBLE AS weight {_LINES} WHERE {_12} GROUP BY 1, 2)"
GADJ = f"edges AS (SELECT DISTINCT {_ENDS} {_LINES} WHERE b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey)"
ARCS = f"arcs AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst {_LINES} WHERE {_12}), {G12}"
TRADE = (
    "edges AS (SELECT DISTINCT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst FROM orders "
    "JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity = 50 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey "
    "WHERE c_nationkey <> s_nationkey)"
)
BOTH = "b AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges)"


def draw(*parts) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 8))::BIGINT"


def values(rows, names: str, alias: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(str, r)) + ')' for r in rows)}) {alias}({names})"


def connected(k: int, alias: str = "x") -> str:
    whole = graphlets.catalog(k)
    return "(SELECT * FROM " + values([(o,) for o, c in enumerate(whole.connected) if c], "ordinal", alias) + ")"


def canon(k: int) -> str:
    whole = graphlets.catalog(k)
    rows = [(o, g, str(whole.connected[o]).lower(), len(whole.edges(o))) for o, g in enumerate(whole.gints)]
    return "(SELECT * FROM " + values(rows, "ordinal, gint, connected, m", "cn") + ")"


def listed(k: int, least_edges: int = 0, ways: int = 0) -> str:
    whole = graphlets.catalog(k)
    out = []
    for o, orbit in enumerate(whole.orbits):
        product = 1
        for n in Counter(orbit).values():
            product *= factorial(n)
        if len(whole.edges(o)) >= least_edges and (not ways or product <= ways):
            out.append(str(o))
    return ", ".join(out)


def sets(k: int) -> str:
    """s{k}(s): sorted lists of k nodes that hang together."""
    parts = [BOTH, "s2 AS (SELECT [src, dst] AS s FROM edges)"]
    for n in range(3, k + 1):
        parts.append(
            f"s{n} AS (SELECT DISTINCT list_sort(list_append(s, v)) AS s FROM (SELECT s, unnest(s) AS u FROM s{n - 1}) x JOIN b USING (u) "
            "WHERE NOT list_contains(s, v))"
        )
    return ", ".join(parts)


def classified(k: int) -> str:
    """cls(s, ordinal, perm), perm from 0."""
    bits = [(i, j, 1 << b) for (i, j), b in ((p, graphlets.bit_of(k)[p]) for p in graphlets.pairs(k))]
    ordinal, perm, _ = graphlets.canonical_map(k)
    rows = [(g, ordinal[g], perm[g].tolist()) for g in range(len(ordinal)) if graphlets.is_connected(g, k)]
    return (
        f"{sets(k)}, pr AS (SELECT * FROM {values(bits, 'i, j, w', 'p')}), cm AS (SELECT * FROM {values(rows, 'gint, ordinal, perm', 'c')}), "
        f"gn AS (SELECT s, sum(w)::BIGINT AS gint FROM (SELECT s, w, s[j + 1] AS src, s[i + 1] AS dst FROM s{k}, pr) JOIN edges USING (src, dst) GROUP BY s), "
        "cls AS (SELECT s, ordinal, perm FROM gn JOIN cm USING (gint))"
    )


def orbited(k: int) -> str:
    """orb(ordinal, node, orbit) over cls."""
    rows = [(o, p, x) for o, orbit in enumerate(graphlets.catalog(k).orbits) for p, x in enumerate(orbit)]
    return (
        f"ob AS (SELECT * FROM {values(rows, 'ordinal, pos, orbit', 'o')}), "
        "orb AS (SELECT cls.ordinal, s[perm[pos + 1] + 1] AS node, orbit FROM cls JOIN ob USING (ordinal))"
    )


def orbit_table_k4() -> str:
    place = graphlets.connected_orbits(4)
    columns = ", ".join(f"count(*) FILTER (orbit = {place[c]}) AS o{i}" for i, c in enumerate(graphlets.ORCA_ORBITS[4]))
    return f"WITH {G12}, {classified(4)}, {orbited(4)} SELECT node, {columns} FROM orb GROUP BY node"


def star_multiplier(k: int) -> str:
    whole = graphlets.catalog(k)
    rows = [(o, sum(len(n) == k - 1 for n in graphlets.neighbours(g, k))) for o, g in enumerate(whole.gints)]
    falling = " * ".join(f"(d - {i})" for i in range(k - 1))
    return (
        f"WITH {G12}, {classified(k)}, d AS (SELECT u, count(*) AS d FROM b GROUP BY u), "
        f"g AS (SELECT (sum({falling}) / {factorial(k - 1)})::DOUBLE AS graph_stars FROM d WHERE d >= {k - 1}), "
        f"c AS (SELECT sum(stars)::DOUBLE AS count_stars FROM cls JOIN {values(rows, 'ordinal, stars', 'st')} USING (ordinal)) "
        "SELECT graph_stars, count_stars, round(graph_stars / count_stars, 9) AS multiplier FROM g, c"
    )


def orbit_rows(k: int) -> str:
    rows = [(o, p, x) for o, orbit in enumerate(graphlets.catalog(k).orbits) for p, x in enumerate(orbit)]
    return (
        f"WITH {G12}, {classified(k)}, ob AS (SELECT * FROM {values(rows, 'ordinal, pos, orbit', 'o')}), "
        "g AS (SELECT s, ordinal, orbit, min(pos) AS first, string_agg((s[perm[pos + 1] + 1])::VARCHAR, ':' ORDER BY (s[perm[pos + 1] + 1])::VARCHAR) AS t "
        "FROM cls JOIN ob USING (ordinal) GROUP BY s, ordinal, orbit) "
        "SELECT ordinal::VARCHAR AS id, string_agg(t, ' ' ORDER BY first) AS groups FROM g GROUP BY s, ordinal"
    )


def communities(k: int) -> str:
    whole = graphlets.catalog(k)
    orbits = [(o, p, x) for o, orbit in enumerate(whole.orbits) for p, x in enumerate(orbit)]
    links = [
        (o, i, j) for o, g in enumerate(whole.gints) if whole.connected[o] for i, j in whole.edges(o) if not graphlets.is_bridge(g, k, (i, j))
    ]
    return (
        f"WITH {G12}, {classified(k)}, ob AS (SELECT * FROM {values(orbits, 'ordinal, pos, orbit', 'o')}), "
        f"nb AS (SELECT * FROM {values(links, 'ordinal, pos, d', 'n')}), "
        "e AS (SELECT s, cls.ordinal, perm, pos, orbit, s[perm[pos + 1] + 1] AS node FROM cls JOIN ob USING (ordinal)), "
        "c AS (SELECT node, orbit AS id, count(*) AS count FROM e GROUP BY 1, 2), "
        "m AS (SELECT DISTINCT node, orbit AS id, s[perm[d + 1] + 1] AS other FROM e JOIN nb USING (ordinal, pos)), "
        "l AS (SELECT node, id, string_agg(other::VARCHAR, ' ' ORDER BY other) AS neighbours FROM m GROUP BY 1, 2) "
        "SELECT node, id, count, coalesce(neighbours, '') AS neighbours FROM c LEFT JOIN l USING (node, id)"
    )


def directed_k3() -> str:
    k = 3
    bits = [(i, j, 1 << b) for (i, j), b in graphlets.bit_of(k, True).items()]
    ordinal, _, _ = graphlets.canonical_map(k, True)
    return (
        f"{sets(3)}, pr AS (SELECT * FROM {values(bits, 'i, j, w', 'p')}), cm AS (SELECT * FROM {values(list(enumerate(ordinal)), 'gint, ordinal', 'c')}), "
        "gn AS (SELECT s, sum(w)::BIGINT AS gint FROM (SELECT s, w, s[i + 1] AS src, s[j + 1] AS dst FROM s3, pr) JOIN arcs USING (src, dst) GROUP BY s), "
        "cls AS (SELECT s, ordinal FROM gn JOIN cm USING (gint))"
    )


def top_pairs(dependencies: list[int], n: int) -> str:
    from math import log

    weights = [1 - log(o) / log(len(dependencies)) for o in dependencies]
    ends = lambda e: f"(SELECT src AS u, dst AS v FROM {e} UNION ALL SELECT dst, src FROM {e})"
    tri = lambda e: f"(SELECT unnest([x.src, x.dst, y.dst]) AS u FROM {e} x JOIN {e} y ON x.dst = y.src JOIN {e} z ON z.src = x.src AND z.dst = y.dst)"

    def vectors(e: str) -> str:
        return (
            f"v{e} AS (SELECT d.u AS node, d.d AS o0, s.x - 2 * coalesce(t.t, 0) AS o1, d.d * (d.d - 1) // 2 - coalesce(t.t, 0) AS o2, coalesce(t.t, 0) AS o3 "
            f"FROM (SELECT u, count(*) AS d FROM {ends(e)} GROUP BY 1) d JOIN (SELECT a.u, sum(b.d - 1) AS x FROM {ends(e)} a JOIN (SELECT u, count(*) AS d FROM {ends(e)} GROUP BY 1) b ON b.u = a.v GROUP BY 1) s USING (u) "
            f"LEFT JOIN (SELECT u, count(*) AS t FROM {tri(e)} GROUP BY 1) t USING (u))"
        )

    far = " + ".join(f"{w!r} * abs(ln(a.o{i} + 1) - ln(b.o{i} + 1)) / ln(greatest(a.o{i}, b.o{i}) + 2)" for i, w in enumerate(weights))
    two = f"whole AS (SELECT DISTINCT {_ENDS} {_LINES} WHERE {_12}), e2 AS (SELECT * FROM whole), e1 AS (SELECT * FROM whole WHERE {draw('src', 'dst', 20)} % 20 <> 0)"
    return (
        f"WITH {two}, {vectors('e1')}, {vectors('e2')} SELECT a.node AS n1, b.node AS n2, round(1 - ({far}) / {sum(weights)!r}, 9) AS similarity "
        f"FROM ve1 a, ve2 b ORDER BY similarity DESC, n1, n2 LIMIT {n}"
    )


def predict(k: int, orbit_a: int, orbit_b: int) -> str:
    rows = [(o, i, j, n) for (o, i, j), n in graphlets.pair_motifs(k, orbit_a, orbit_b).items()]
    total = " + ".join(f"d{p}.inv" for p in range(k))
    joins = " ".join(f"JOIN inv d{p} ON d{p}.x = own[{p + 1}]" for p in range(k))
    pick = lambda c: " ".join(f"WHEN {c} = {p} THEN d{p}.inv" for p in range(k))
    return (
        f"WITH {G12}, {classified(k)}, pm AS (SELECT * FROM {values(rows, 'ordinal, i, j, n', 'p')}), "
        "inv AS (SELECT u AS x, 1 / count(*) AS inv FROM b GROUP BY u), "
        "o AS (SELECT ordinal, list_transform(perm, lambda p: s[p + 1]) AS own FROM cls WHERE ordinal IN (SELECT ordinal FROM pm)), "
        f"t AS (SELECT least(own[i + 1], own[j + 1]) AS u, greatest(own[i + 1], own[j + 1]) AS v, n * ({total} - CASE {pick('i')} END - CASE {pick('j')} END) AS x "
        f"FROM o JOIN pm USING (ordinal) {joins}) SELECT u, v, round(sum(x), 6) AS score FROM t GROUP BY 1, 2 HAVING round(sum(x), 6) <> 0"
    )


def count_pair(k: int) -> str:
    """cp(ordinal, a, c): counts of sets of three in e1 and e2, by closed form."""
    parts = []
    for e in ("e1", "e2"):
        parts.append(
            f"t{e} AS (SELECT count(*) AS t FROM {e} x JOIN {e} y ON x.dst = y.src JOIN {e} z ON z.src = x.src AND z.dst = y.dst), "
            f"w{e} AS (SELECT sum(d * (d - 1) / 2) AS w FROM (SELECT u, count(*) AS d FROM (SELECT src AS u FROM {e} UNION ALL SELECT dst FROM {e}) GROUP BY 1))"
        )
    rows = "cp AS (SELECT (SELECT w FROM we1) - 3 * (SELECT t FROM te1) AS a, (SELECT w FROM we2) - 3 * (SELECT t FROM te2) AS c UNION ALL SELECT (SELECT t FROM te1), (SELECT t FROM te2))"
    return ", ".join(parts) + ", " + rows


def accept_reject(k: int, n: int) -> str:
    return (
        f"WITH {GADJ}, {BOTH}, nd AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS no FROM (SELECT DISTINCT u AS id FROM b)), c AS (SELECT count(*) AS c FROM nd), "
        f"t AS (SELECT s.range AS sample, i.range AS i FROM range({n}) s, range({k}) i), "
        f"d AS (SELECT sample, {draw('1', 'sample', 'i')} % c AS no FROM t, c), "
        "g AS (SELECT sample, list_sort(list(DISTINCT id)) AS s FROM d JOIN nd USING (no) GROUP BY 1), "
        "w AS (SELECT sample, s FROM g WHERE len(s) = 3), "
        "e AS (SELECT sample, s, count(*) AS m FROM w, (VALUES (1, 2), (1, 3), (2, 3)) p(i, j) JOIN edges ON src = s[i] AND dst = s[j] GROUP BY 1, 2) "
        "SELECT sample, array_to_string(s, ' ') AS nodes FROM e WHERE m >= 2"
    )


def expand_sets(k: int) -> str:
    """Sets grown from every node by the neighbours of the highest degree, all ties."""
    parts = [BOTH, "h AS (SELECT u, count(*) AS h FROM b GROUP BY u)", "x1 AS (SELECT DISTINCT [u] AS s FROM b)"]
    for n in range(2, k + 1):
        parts.append(
            f"c{n} AS (SELECT DISTINCT s, v, h.h FROM (SELECT s, unnest(s) AS u FROM x{n - 1}) y JOIN b USING (u) JOIN h ON h.u = b.v WHERE NOT list_contains(s, v)), "
            f"x{n} AS (SELECT DISTINCT list_sort(list_append(s, v)) AS s FROM (SELECT *, max(h) OVER (PARTITION BY s) AS top FROM c{n}) WHERE h = top)"
        )
    return f"WITH {G12}, {', '.join(parts)} SELECT array_to_string(s, ' ') AS nodes FROM x{k}"


def minimum(gint: int, k: int) -> int:
    """The least number of all relabellings, the plain way."""
    from itertools import permutations

    edges = graphlets.decode(gint, k)
    return min(graphlets.encode([(p[i], p[j]) for i, j in edges], k) for p in permutations(range(k)))


class Plain:
    """Catalogs of k nodes the plain way: every relabelling of every graph, tried one by one."""

    def __init__(self, k: int) -> None:
        from itertools import combinations, permutations

        self.k = k
        self.pairs = [p for p, _ in sorted(graphlets.bit_of(k).items(), key=lambda x: x[1]) if p[0] > p[1]]
        place = {frozenset(p): i for i, p in enumerate(self.pairs)}
        moves = [[place[frozenset((p[i], p[j]))] for i, j in self.pairs] for p in permutations(range(k))]
        perms = list(permutations(range(k)))
        self.least = [min(sum(1 << m[b] for b in range(len(m)) if g >> b & 1) for m in moves) for g in range(1 << len(self.pairs))]
        self.numbers = sorted(set(self.least))
        self.ordinal = {g: i for i, g in enumerate(self.numbers)}
        self.orbits = []
        nth = 0
        for g in self.numbers:
            same = [p for p, m in zip(perms, moves) if sum(1 << m[b] for b in range(len(m)) if g >> b & 1) == g]
            first = [min(p[v] for p in same) for v in range(k)]
            names = {v: nth + i for i, v in enumerate(sorted(set(first)))}
            nth += len(names)
            self.orbits.append([names[v] for v in first])
        self._subsets = [c for n in range(1, k) for c in combinations(range(k), n)]

    def edges(self, gint: int) -> list[tuple[int, int]]:
        return [p for b, p in enumerate(self.pairs) if gint >> b & 1]

    def connected(self, gint: int) -> bool:
        """No set of some nodes without an edge to the others."""
        ends = self.edges(gint)
        return all(any((u in c) != (v in c) for u, v in ends) for c in self._subsets)

    def ways(self, gint: int) -> int:
        """Sequences of edges that build the graph node by node, each from an edge to a node within to one outside."""
        ends = self.edges(gint)

        def more(held: frozenset) -> int:
            if len(held) == self.k:
                return 1
            return sum(more(held | {u, v}) for u, v in ends if (u in held) != (v in held))

        return sum(more(frozenset(e)) for e in ends) if self.connected(gint) else 0

    def without(self, gint: int, node: int, smaller: Plain) -> int:
        at = {v: i for i, v in enumerate(v for v in range(self.k) if v != node)}
        kept = {frozenset((at[u], at[v])) for u, v in self.edges(gint) if node not in (u, v)}
        return smaller.ordinal[smaller.least[sum(1 << b for b, p in enumerate(smaller.pairs) if frozenset(p) in kept)]]


@lru_cache(maxsize=None)
def plain(k: int) -> Plain:
    return Plain(k)


def _table(rows, names: str) -> str:
    return f"SELECT * FROM {values(rows, names, 'x')}"


def plain_map(k: int) -> str:
    return _table([(g, c) for g, c in enumerate(plain(k).least)], "gint, canonical")


def plain_orbits(k: int) -> str:
    own = plain(k)
    rows, place = [], {}
    for o, g in enumerate(own.numbers):
        for p, x in enumerate(own.orbits[o]):
            if own.connected(g):
                place.setdefault(x, len(place))
            rows.append((o, p, x, place.get(x, "NULL")))
    return _table(rows, "ordinal, pos, orbit, connected_orbit")


def plain_alphas(k: int) -> str:
    own = plain(k)
    return _table([(o, own.ways(g)) for o, g in enumerate(own.numbers)], "ordinal, alpha").replace("SELECT *", "SELECT ordinal, alpha::BIGINT AS alpha")


def plain_subcanonicals(k: int) -> str:
    own, less = plain(k), plain(k - 1)
    return _table([(o, v, own.without(g, v, less)) for o, g in enumerate(own.numbers) for v in range(k)], "ordinal, removed, sub_ordinal")


def plain_distances(k: int) -> list[tuple[int, int, int]]:
    """Edge flips between graphs, by flipping: breadth first from each canonical graph over all numbers."""
    own, out = plain(k), []
    for o, g in enumerate(own.numbers):
        seen, front, steps = {g}, [g], 0
        near = {o: 0}
        while front:
            steps += 1
            front = [x for x in {y ^ (1 << b) for y in front for b in range(len(own.pairs))} if x not in seen]
            seen |= set(front)
            for x in front:
                near.setdefault(own.ordinal[own.least[x]], steps)
        out += [(o, c, d) for c, d in near.items()]
    return out


def plain_chains(k: int) -> str:
    rows = []
    for o, g in enumerate(plain(k).numbers):
        n, at = k, o
        rows.append((o, n, at))
        while n > 3:
            own, less = plain(n), plain(n - 1)
            at = min({own.without(own.numbers[at], v, less) for v in range(n)}, key=lambda c: (not less.connected(less.numbers[c]), c))
            n -= 1
            rows.append((o, n, at))
    return _table(rows, "ordinal, chain_k, chain_ordinal")


def plain_report(k: int) -> str:
    own = plain(k)
    rows = [(o, str(own.connected(g)).lower(), g, "'" + " ".join(sorted({str(x) for x in own.orbits[o]}, key=int)) + "'") for o, g in enumerate(own.numbers)]
    return _table(rows, "ordinal, connected, gint, orbits")


def ks(values_of: str, value: str) -> str:
    """The distance of two distributions told as v(value, a, b): the largest gap of running shares, its chance and the Euclidean
    distance of shares."""
    lam = "(sqrt(n) + 0.12 + 0.11 / sqrt(n)) * ks"
    return (
        f"WITH {values_of}, t AS (SELECT sum(a) AS na, sum(b) AS nb FROM v), s AS (SELECT {value}, a / na AS a, b / nb AS b, na, nb FROM v, t), "
        f"g AS (SELECT abs(sum(a) OVER w - sum(b) OVER w) AS gap, (a - b) * (a - b) AS sq, na, nb FROM s WINDOW w AS (ORDER BY {value})), "
        "f AS (SELECT round(max(gap), 9) AS ks, round(sqrt(sum(sq)), 9) AS euclidean, max(na) * max(nb) / (max(na) + max(nb)) AS n FROM g), "
        f"l AS (SELECT *, {lam} AS lam FROM f) SELECT ks, euclidean, round(CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, "
        "(SELECT sum(2 * CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * lam * lam)) FROM (SELECT unnest(range(1, 101)) AS j)))) END, 9) AS p_value FROM l"
    )


def held_out(k: int, orbit_a: int, orbit_b: int, n: int) -> str:
    """How many of the n best predictions from nine tenths of the edges are in the last tenth."""
    part = f"p AS (SELECT src, dst, row_number() OVER (ORDER BY {draw('src', 'dst', 11)}, src, dst) <= ceil((SELECT count(*) FROM whole) * 10 / 100) AS test FROM whole)"
    graph = f"{G12.replace('edges AS', 'whole AS')}, {part}, edges AS (SELECT src, dst FROM p WHERE NOT test)"
    scored = predict(k, orbit_a, orbit_b).replace(f"WITH {G12}", f"WITH {graph}")
    best = f"best AS (SELECT u, v FROM ({scored.partition(') SELECT u, v,')[2].join(['SELECT u, v,', ''])}) WHERE (u, v) NOT IN (SELECT (src, dst) FROM edges) ORDER BY score DESC, u, v LIMIT {n})"
    return f"{scored.partition(') SELECT u, v,')[0]}), {best} SELECT (SELECT count(*) FROM best) AS predicted, (SELECT count(*) FROM best JOIN p ON p.src = u AND p.dst = v WHERE test) AS hits"


def hamming_objective(k: int) -> str:
    """Surplus counts of a graph without a twentieth of its edges times their mean distance to what it is short of."""
    named = f"WITH whole AS (SELECT DISTINCT {_ENDS} {_LINES} WHERE {_12}), "

    def counts(name: str, where: str) -> str:
        own = f"edges AS (SELECT * FROM whole{where}), {classified(k)}"
        return f"{name} AS (WITH {own} SELECT ordinal, count(*)::DOUBLE AS n FROM cls GROUP BY 1)"

    return (
        f"{named}{counts('c1', " WHERE " + draw("src", "dst", 20) + " % 20 <> 0")}, {counts('c2', '')}, "
        f"far AS (SELECT * FROM {values(plain_distances(k), 'a, b, dist', 'd')}), "
        "gap AS (SELECT ordinal, coalesce(c1.n, 0) - coalesce(c2.n, 0) AS gap FROM c1 FULL JOIN c2 USING (ordinal)), "
        "l AS (SELECT sum(-gap) AS al FROM gap WHERE gap < 0) "
        "SELECT round(coalesce(sum(x.gap * -y.gap / al * dist), 0), 6)::DOUBLE AS hamming FROM gap x JOIN far ON a = x.ordinal JOIN gap y ON b = y.ordinal, l WHERE x.gap > 0 AND y.gap < 0"
    )


def exact_orbits4() -> str:
    place3 = (3, 4, 5)
    place4 = graphlets.connected_orbits(4)
    small = ", ".join(f"count(*) FILTER (orbit = {o}) AS o{i + 1}" for i, o in enumerate(place3))
    large = ", ".join(f"count(*) FILTER (orbit = {place4[c]}) AS o{i + 4}" for i, c in enumerate(graphlets.ORCA_ORBITS[4]))
    own = lambda k, name, columns: f"{name} AS (WITH {classified(k)}, {orbited(k)} SELECT node, {columns} FROM orb GROUP BY node)"
    columns = ", ".join(f"coalesce(o{i}, 0)::BIGINT AS o{i}" for i in range(1, 15))
    return (
        f"WITH {G12}, {BOTH.replace('b AS', 'dd AS')}, {own(3, 'x3', small)}, {own(4, 'x4', large)}, n AS (SELECT u AS node, count(*) AS o0 FROM dd GROUP BY 1) "
        f"SELECT node, o0, {columns} FROM n LEFT JOIN x3 USING (node) LEFT JOIN x4 USING (node)"
    )


def cores(told: str) -> str:
    """est(id, h): estimates that fall from the degree to the h-index of the neighbours'."""
    return (
        f"WITH RECURSIVE {G12}, {BOTH}, est(id, h) USING KEY (id) AS (SELECT u, count(*) FROM b GROUP BY u UNION "
        "SELECT id, nh FROM (SELECT u AS id, max(least(rn, h)) AS nh, any_value(own) AS own FROM "
        "(SELECT b.u, r.h, o.h AS own, row_number() OVER (PARTITION BY b.u ORDER BY r.h DESC) AS rn "
        "FROM b JOIN recurring.est r ON r.id = b.v JOIN recurring.est o ON o.id = b.u WHERE (SELECT count(*) FROM est) > 0) GROUP BY u) WHERE nh < own) " + told
    )


def plain_catalog(k: int) -> str:
    own, rows = plain(k), []
    for o, g in enumerate(own.numbers):
        ends = own.edges(g)
        stars = sum(sum(v in e for e in ends) == k - 1 for v in range(k))
        rows.append((o, g, str(own.connected(g)).lower(), len(ends), "'" + " ".join(f"{j},{i}" for i, j in sorted(ends, key=lambda e: (e[1], e[0]))) + "'", "'" + " ".join(map(str, own.orbits[o])) + "'", stars))
    return _table(rows, "ordinal, gint, connected, m, edges, orbits, stars")


def plain_unambiguous(k: int, most: int) -> str:
    rows = []
    for o, orbit in enumerate(plain(k).orbits):
        ways = 1
        for n in Counter(orbit).values():
            ways *= factorial(n)
        if ways <= most:
            rows.append((o, ways))
    return _table(rows, "ordinal, ways")


def plain_chained(k: int) -> str:
    own = plain(k)
    whole = [own.edges(g) for g in own.numbers if own.connected(g)]
    rows = {tuple(sorted((n * (k - 1) + i, n * (k - 1) + j))) for n, ends in enumerate(whole) for i, j in ends}
    return _table(sorted(rows), "src, dst")


def plain_directed_totals() -> str:
    from itertools import permutations

    rows = []
    for k in (3, 4):
        arcs = [(i, j) for i in range(k) for j in range(k) if i != j]
        place = {a: b for b, a in enumerate(arcs)}
        moves = [[place[(p[i], p[j])] for i, j in arcs] for p in permutations(range(k))]
        left, sizes = set(range(1 << len(arcs))), []
        while left:
            g = left.pop()
            bits = [b for b in range(len(arcs)) if g >> b & 1]
            left -= {sum(1 << m[b] for b in bits) for m in moves}
            sizes.append(len(bits))
        rows.append((k, len(sizes), len(set(sizes))))
    return _table(rows, "k, canonicals, arc_counts")


def plain_drawings(k: int) -> str:
    own, rows = plain(k), []
    for o, g in enumerate(own.numbers):
        parts = [f'{v} [label="{v}:{x}"];' for v, x in enumerate(own.orbits[o])] + [f"{j} -- {i};" for i, j in sorted(own.edges(g), key=lambda e: (e[1], e[0]))]
        rows.append((o, f"'graph g{o} {{ {' '.join(parts)} }}'"))
    return _table(rows, "ordinal, dot")


def plain_crosswalk(k: int) -> str:
    """Names by the lower triangle and by the upper one: there the least number that any of a graph's relabellings has."""
    own = plain(k)
    above = {frozenset(p): b for b, p in enumerate((i, j) for i in reversed(range(k)) for j in reversed(range(i + 1, k)))}
    upper = [10**9] * len(own.numbers)
    for g, low in enumerate(own.least):
        o = own.ordinal[low]
        upper[o] = min(upper[o], sum(1 << above[frozenset(e)] for e in own.edges(g)))
    rank = {o: r for r, o in enumerate(sorted(range(len(upper)), key=upper.__getitem__))}
    orbits = [len(set(x)) for x in own.orbits]
    linked = [own.connected(g) for g in own.numbers]
    rows = []
    for o, g in enumerate(own.numbers):
        sums = []
        for place in (lambda x: x, rank.__getitem__):
            before = [x for x in range(len(upper)) if place(x) < place(o)]
            sums += [sum(orbits[x] for x in before if linked[x]) if linked[o] else 0, sum(orbits[x] for x in before)]
        rows.append((int(linked[o]), rank[o], upper[o], g, o, orbits[o], own.orbits[o].count(own.orbits[o][0]), *sums))
    names = "connected, upper_ordinal, upper_decimal, lower_decimal, lower_ordinal, num_orbits, first_orbit_nodes, first_orbit_connected, first_orbit_all, first_orbit_connected_upper, first_orbit_all_upper"
    return _table(rows, names)
