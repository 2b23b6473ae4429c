import pytest

from weftline.operators import graph as G
from weftline.queries import fixture_scan


def of(spark, *edges, alone=()):
    g = G.Graph.of_pairs(spark.createDataFrame(list(edges), "source string, target string"))
    if alone:
        g = G.Graph(g.nodes.union(spark.createDataFrame([(n, "other") for n in alone], "name string, layer string")), g.edges)
    return g


LINE = (("src.orders", "ods.orders"), ("ods.orders", "dwd.order_line"), ("dwd.order_line", "dws.nation_day"), ("dws.nation_day", "ads.board"), ("ads.board", "app.page"))
#: One source that reaches one sink by ways of two and three steps.
FORK = (("src.sale", "ods.sale"), ("ods.sale", "dws.day"), ("src.sale", "ods.refund"), ("ods.refund", "dwd.net"), ("dwd.net", "dws.day"))


def test_line(spark):
    g = of(spark, *LINE)
    assert {r.name: r.level for r in G.levels(g, "src.orders").collect()} == {"ods.orders": 1, "dwd.order_line": 2, "dws.nation_day": 3, "ads.board": 4, "app.page": 5}
    assert {r.name: r.level for r in G.levels(g, "ads.board", up=True, depth=2).collect()} == {"dws.nation_day": 1, "dwd.order_line": 2}
    assert {r.name: r.depth for r in G.depths(g).collect()}["app.page"] == 5
    assert G.topological_order(g) == ["src.orders", "ods.orders", "dwd.order_line", "dws.nation_day", "ads.board", "app.page"]
    assert G.stats(g)["max_depth"] == 5 and G.stats(g)["cycles"] == 0
    assert G.resolve(g, "PAGE") == "app.page" and G.resolve(g, "zzz") is None


def test_fork(spark):
    g = of(spark, *FORK)
    ways = [["src.sale", "ods.sale", "dws.day"], ["src.sale", "ods.refund", "dwd.net", "dws.day"]]
    assert [r.path for r in G.paths(g, "src.sale").collect()] == ways
    assert [r.n_nodes for r in G.paths_between(g, "src.sale", "dws.day").collect()] == [3, 4] and G.shortest(g, "src.sale", "dws.day") == 3
    assert [r.path for r in G.paths_between(g, "dws.day", "dws.day").collect()] == [["dws.day"]]
    x = G.impact(g, "src.sale")
    assert x["found"] and x["levels"] == {1: ["ods.refund", "ods.sale"], 2: ["dwd.net", "dws.day"]} and len(x["edges"]) == 5 and x["leaves"] == ["dws.day"]
    assert G.impact(g, "nothing")["found"] is False
    assert sorted(r.name for r in G.focus(g, "dwd.net").nodes.collect()) == ["dwd.net", "dws.day", "ods.refund", "src.sale"]


def test_cycles(spark):
    """A ring of three, a table that reads itself, a table behind the ring, one alone."""
    g = of(spark, ("ods.ring1", "dwd.ring2"), ("dwd.ring2", "dws.ring3"), ("dws.ring3", "ods.ring1"), ("tmp.self", "tmp.self"), ("dws.ring3", "ads.behind"), alone=["src.one"])
    assert [(r.component, r.nodes) for r in G.cycles(g).collect()] == [("tmp.self", ["tmp.self"]), ("dwd.ring2", ["dwd.ring2", "dws.ring3", "ods.ring1"])]
    assert G.cycle_path(g, "dwd.ring2") == ["dwd.ring2", "dws.ring3", "ods.ring1", "dwd.ring2"] and G.cycle_path(g, "tmp.self") == ["tmp.self", "tmp.self"]
    assert G.topological_order(g) is None and G.topological_levels(g).count() == 0
    assert {r.name: r.depth for r in G.depths(g).collect()} == {"ods.ring1": 0, "dwd.ring2": 0, "dws.ring3": 0, "tmp.self": 0, "ads.behind": 1, "src.one": 0}
    assert [r.name for r in G.isolated(g).collect()] == ["src.one"]
    assert [r.path for r in G.paths(g, "ods.ring1").collect()] == [["ods.ring1", "dwd.ring2", "dws.ring3", "ads.behind"]]


def test_large_graphs_are_walked_by_joins(spark, monkeypatch):
    """The same rows, whether a graph is walked on the driver or by joins."""
    import random

    rnd = random.Random(4)
    edges = sorted({(f"t{rnd.randrange(24)}", f"t{rnd.randrange(24)}") for _ in range(34)} | {("a", "b"), ("b", "c"), ("c", "a"), ("c", "t0")})

    def all_of():
        g = of(spark, *edges, alone=["alone"])
        rows = lambda df: sorted(map(str, df.collect()))
        found = [rows(G.levels(g, "a")), rows(G.levels(g, "t0", up=True, depth=2)), rows(G.scc(g)), rows(G.cycles(g)), rows(G.depths(g)), rows(G.topological_levels(g))]
        line = of(spark, *LINE, *FORK)
        return [*found, rows(G.topological_levels(line)), rows(G.paths(line, "src.sale")), rows(G.paths_between(line, "src.orders", "app.page")), rows(G.paths_between(g, "a", "t0", max_length=4))]

    small = all_of()
    monkeypatch.setattr(G, "SMALL", 3)
    large = all_of()
    for a, b in zip(small, large, strict=True):
        assert a == b


def test_dense_graphs_end(spark, monkeypatch):
    """Path listings of a graph in which every table feeds every other end, with the shortest ways first."""
    monkeypatch.setattr(G, "TRIED", 20_000)
    names = [f"t{i:02}" for i in range(14)]
    g = of(spark, *[(a, b) for a in names for b in names if a != b])
    got = G.paths_between(g, "t00", "t13").collect()
    assert len(got) == 20 and got[0].path == ["t00", "t13"] and got[1].path == ["t00", "t01", "t13"]
    assert G.paths(g, "t00", depth=3).count() == 100


def test_mermaid_options(spark):
    g = of(spark, *LINE)
    text = G.mermaid(g, "dws.nation_day", depth=1, group_layers=True)
    assert "app.page" not in text and "ads.board" in text and text.count("subgraph") == text.count("  end") == 3


def test_build_and_round_trip(spark, tmp_path):
    g = fixture_scan(spark).graph()
    e = {(r.source, r.target): r for r in g.edges.collect()}
    x = e["ods.lineitem", "dwd.dwd_order_line"]
    assert (x.column_mappings, x.unresolved_mappings, x.constant_mappings, x.columns_truncated) == (5, 0, 0, False) and len(x.columns) == 5
    assert e["src.lineitem", "ods.lineitem"].partition_filters == {"dt": ["2026-01-01"]}
    G.save(g, str(tmp_path / "g"))
    again = G.load(spark, str(tmp_path / "g"))
    assert G.to_dict(again) == G.to_dict(g) == G.to_dict(G.from_dict(spark, G.to_dict(g), g))
    assert "flowchart" in G.mermaid(g, "dwd.dwd_order_line") and ":::center" in G.mermaid(g, "dwd.dwd_order_line")
    with pytest.raises(ValueError):
        G.mermaid(g, "no.table")


def test_constants_count_for_a_single_source(spark):
    from weftline.plans.lineage import columns_frame, parse_sql, statements_frame

    r = parse_sql(spark, "INSERT INTO a SELECT 1 AS k, x FROM b; INSERT INTO c SELECT 1 AS k, b.x FROM b JOIN d ON b.i = d.i")
    e = {(x.source, x.target): x.constant_mappings for x in G.build(statements_frame(spark, r), columns_frame(spark, r)).edges.collect()}
    assert e == {("b", "a"): 1, ("b", "c"): 0, ("d", "c"): 0}
