import bz2
import gzip
import lzma

import pytest

from motiflake.plans.runs import Run, budget
from motiflake.sources import formats, sinks

PLAIN = "# a comment\na b\nb\tc\n\n c  d \n"
WANT = [("a", "b"), ("b", "c"), ("c", "d")]


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


@pytest.mark.parametrize("ending,pack", [(".el", bytes), (".el.gz", gzip.compress), (".el.bz2", bz2.compress), (".el.xz", lzma.compress)])
def test_edge_lists(spark, tmp_path, ending, pack):
    path = tmp_path / f"g{ending}"
    path.write_bytes(pack(PLAIN.encode()))
    assert pairs(formats.read(spark, str(path))) == WANT


@pytest.mark.parametrize(
    "name,text",
    [
        ("g.csv", "a;b\nb;c\nc;d\n"),
        ("g.lgf", "@nodes\nlabel\n@edges\n label weight\na b 0 1\nb c 1 1\nc d 2 1\n"),
        ("g.graphml", '<graph>\n<edge source="a" target="b"/>\n<edge id="e" source="b" target="c"/>\n<edge source="c" target="d"></edge>\n</graph>'),
        ("g.gml", "graph [\n node [ id a ]\n edge [\n source a\n target b\n ]\n edge [ source b target c ]\n edge [\n  source c\n  target d\n  weight 2 ] ]"),
        ("g.gw", "LEDA.GRAPH\nstring\nshort\n-2\n4\n|{a}|\n|{b}|\n|{c}|\n|{d}|\n3\n1 2 0 |{}|\n2 3 0 |{}|\n3 4 0 |{x}|\n"),
    ],
)
def test_formats(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    assert pairs(formats.read(spark, str(tmp_path / name))) == WANT


def test_unknown_ending(spark):
    with pytest.raises(ValueError):
        formats.read(spark, "graph.xyz")


def test_side_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    edges = formats.edge_list(spark, put("w.el", "a b 0.5\nb c 2\n"), weighted=True)
    assert [r["weight"] for r in edges.orderBy("src").collect()] == [0.5, 2.0]
    assert [r["id"] for r in formats.interest(spark, put("i", "a\nc\n"), edges).orderBy("id").collect()] == ["a", "c"]
    for bad in ("a\na\n", "z\n"):
        with pytest.raises(ValueError):
            formats.interest(spark, put("bad", bad), edges)
    vectors = formats.orbit_vectors(spark, put("o", "5\na 1 2 3\nb\n"))
    assert {r["node"]: r["vector"] for r in vectors.collect()} == {"a": [1, 2, 3], "b": []}
    known = edges.selectExpr("src as id").union(edges.selectExpr("dst as id")).distinct()
    assert {r["id"]: r["heur"] for r in formats.orbit_value(vectors, known, 1).collect()} == {"a": 2.0, "b": 0.0, "c": 0.0}
    lines = formats.index_lines(spark, put("x", "7+o1 a b c\n9+o0 b c d\nbroken\n"), 3)
    assert [tuple(r) for r in lines.orderBy("line_no").collect()] == [(0, "7+o1", ["a", "b", "c"]), (1, "9+o0", ["b", "c", "d"])]
    assert formats.seeds(spark, put("s", "k a,b c,d\n")).first()["nodes2"] == ["c", "d"]
    assert pairs(formats.orthologs(spark, put("t", "x\ty\na\tb\n0\tc\n"), "x", "y").selectExpr("n1 as src", "n2 as dst")) == [("a", "b")]
    assert formats.similarities(spark, put("m", "a b 0.25\n")).first()["similarity"] == 0.25
    rows = formats.partition(spark, put("p", "a b\n"), known).collect()
    assert {r["node"]: r["community"] for r in rows} == {"a": 0, "b": 0, "c": -1}
    assert formats.importance(spark, put("n", "a 1.5\n")).first()["weight"] == 1.5


def test_clusters_round_trip(spark, tmp_path):
    from motiflake.operators.local import cluster_lines

    found = spark.createDataFrame([(0, 3, 3, 1.0, [1, 2, 3])], "cluster long, n long, m long, density double, nodes array<bigint>")
    sinks.lines(cluster_lines(found), str(tmp_path / "c"))
    assert tuple(formats.clusters(spark, str(tmp_path / "c")).first()) == (0, 3, 3, 1.0, [1, 2, 3])


def test_runs_and_sinks(spark, tmp_path):
    (tmp_path / "g.el").write_text("a b\nb c\na c\nc d\nd e\n")
    assert budget("2k") == 2048 and budget("7") == 7
    found, names = Run(k=3, method="EXACT").on_file(spark, str(tmp_path / "g.el"))
    assert {r["ordinal"]: r["count"] for r in found.collect()} == {2: 3, 3: 1}
    assert names.count() == 5
    for mode in ("concentration", "odv", "gdv", "index", "rooted", "orbits", "communities"):
        assert Run(k=3, method="EXACT", mode=mode, ambiguity=0).on_file(spark, str(tmp_path / "g.el"))[0].count() > 0
    for method in ("EBE", "NBE", "MCMC", "AR"):
        assert Run(k=3, method=method, samples="600").on_file(spark, str(tmp_path / "g.el"))[0].count() == 2
    sinks.frequency(found, str(tmp_path / "f"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "f")).collect()) == ["1 3", "3 2"]
    rows = Run(k=3, method="EXACT", mode="index", ambiguity=0).on_file(spark, str(tmp_path / "g.el"))[0]
    sinks.index(rows, str(tmp_path / "i"))
    assert formats.index_lines(spark, str(tmp_path / "i"), 3).count() == 4
    sinks.vectors(Run(k=3, method="EXACT", mode="odv").on_file(spark, str(tmp_path / "g.el"))[0], str(tmp_path / "v"))
    assert formats.orbit_vectors(spark, str(tmp_path / "v")).count() == 5
