"""The lineage graph as two DataFrames, and its traversals.

``nodes(name, schema, table, layer, ref_count, produced_by, consumed_by)`` and ``edges(source, target, ...)``. A graph of
at most SMALL edges (counted, by a limit) is fetched once and walked on the driver, where a Spark job a round would
cost more than the graph is worth. Larger graphs are walked by joins: traversals keep a frontier DataFrame, join it with
the edges and take away what was seen; each round's frontier is written to a checkpoint, so plans stay short and lost
executors cost one round. Both ways give the same rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import LAYERS, table_layer
from ..plans.lineage import local_frame
from ..runtime import shared_dir

MAX_COLUMNS_PER_EDGE = 200
MAX_PATHS, MAX_PATHS_BETWEEN, MAX_LENGTH = 100, 20, 12
#: Edges up to which a graph is walked on the driver (some 100 bytes each there), and paths tried there at most.
SMALL, TRIED = 250_000, 2_000_000


def _kept(df: DataFrame) -> DataFrame:
    """Cut from its lineage, in the folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    _pairs: list | None = field(default=None, repr=False)

    def pairs(self) -> list[tuple[str, str]] | None:
        """The distinct (source, target), sorted, of a graph of at most SMALL edges; None of a larger one. Fetched once."""
        if self._pairs is None:
            got = self.edges.select("source", "target").limit(SMALL + 1).toArrow()
            self._pairs = [] if got.num_rows > SMALL else [sorted(set(zip(got["source"].to_pylist(), got["target"].to_pylist(), strict=True)))]
        return self._pairs[0] if self._pairs else None

    @classmethod
    def of_pairs(cls, edges: DataFrame) -> Graph:
        """From (source, target) alone."""
        e = edges.select("source", "target").distinct()
        return cls(e.select(F.col("source").alias("name")).union(e.select("target")).distinct().withColumn("layer", table_layer(F.col("name"))), e)


def build(statements: DataFrame, columns: DataFrame) -> Graph:
    """Nodes and edges of statement and column records."""
    who = F.struct(F.col("source").alias("file"), "statement_index", "task_type")
    used = statements.select(F.explode("input_table_names").alias("name"), who.alias("w")).groupBy("name").agg(F.count("*").alias("ref_count"), F.array_sort(F.collect_set("w")).alias("consumed_by"))
    made = statements.select(F.explode("output_table_names").alias("name"), who.alias("w")).groupBy("name").agg(F.array_sort(F.collect_set("w")).alias("produced_by"))
    none = F.array().cast("array<struct<file:string,statement_index:int,task_type:string>>")
    nodes = used.join(made, "name", "full").select(
        "name", F.when(F.instr("name", ".") > 0, F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)).alias("schema"), F.element_at(F.split("name", r"\."), -1).alias("table"),
        table_layer(F.col("name")).alias("layer"), F.coalesce("ref_count", F.lit(0)).alias("ref_count"), F.coalesce("produced_by", none).alias("produced_by"), F.coalesce("consumed_by", none).alias("consumed_by"),
    )
    flow = statements.where(F.size("output_table_names") > 0).select(F.col("source").alias("file"), "statement_index", "task_type", F.explode("output_table_names").alias("target"), "input_table_names", "partition_filters")
    pairs = flow.select("file", "statement_index", "task_type", "target", F.explode("input_table_names").alias("source"), F.size("input_table_names").alias("n_inputs"), "partition_filters")
    base = pairs.groupBy("source", "target").agg(
        F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_set(F.struct("file", "statement_index", "task_type"))).alias("statements"),
        F.max_by("partition_filters", F.struct("file", "statement_index")).alias("partition_filters"),
    )
    c = columns.withColumnRenamed("source_table", "s").join(pairs.select("file", "statement_index", "source", "target", "n_inputs"), ["file", "statement_index"])
    c = c.where((F.col("target_table") == F.col("target")) & ((F.col("s") == F.col("source")) | (F.col("s").isNull() & (F.col("n_inputs") == 1))))
    own = F.col("s").isNotNull()
    stats = c.groupBy("source", "target").agg(
        F.count_if(own & F.col("resolved")).alias("column_mappings"), F.count_if(own & ~F.col("resolved")).alias("unresolved_mappings"), F.count_if(~own).alias("constant_mappings"),
        F.array_sort(F.collect_set(F.struct("file", "statement_index", "pos", "target_column", "source_column", "expression", "resolved"))).alias("all"),
    )
    edges = base.join(stats, ["source", "target"], "left").select(
        "source", "target", "files", "statements", "partition_filters", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("column_mappings", "unresolved_mappings", "constant_mappings")],
        F.transform(F.slice(F.coalesce("all", F.array().cast(stats.schema["all"].dataType)), 1, MAX_COLUMNS_PER_EDGE), lambda x: F.struct(x["target_column"].alias("target_column"), x["source_column"].alias("source_column"), x["expression"].alias("expression"), x["resolved"].alias("resolved"))).alias("columns"),
        (F.coalesce(F.size("all"), F.lit(0)) > MAX_COLUMNS_PER_EDGE).alias("columns_truncated"),
    )
    return Graph(nodes, edges)


# ---- names and neighbours


def candidates(g: Graph, name: str) -> DataFrame:
    """Names that match: exactly, else without case, else by their ending or short name."""
    key = name.strip().strip("`\"'")
    low = F.lower("name")
    rank = F.when(F.col("name") == key, 0).when(low == key.lower(), 1).when(low.endswith("." + key.lower()) | (F.element_at(F.split(low, r"\."), -1) == key.lower().split(".")[-1]), 2)
    found = g.nodes.select("name", rank.alias("rank")).where("rank is not null")
    return found.where(F.col("rank") == found.agg(F.min("rank")).first()[0]) if found.limit(1).count() else found


def resolve(g: Graph, name: str) -> str | None:
    got = [r.name for r in candidates(g, name).limit(2).collect()]
    return got[0] if len(got) == 1 else None


def degrees(g: Graph) -> DataFrame:
    e = g.edges.select("source", "target").distinct()
    out = e.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("out_degree"))
    into = e.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("in_degree"))
    x = g.nodes.select("name").join(out, "name", "left").join(into, "name", "left")
    return x.select("name", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def roots(g: Graph) -> DataFrame:
    return g.nodes.select("name").join(g.edges.select(F.col("target").alias("name")), "name", "left_anti")


def leaves(g: Graph) -> DataFrame:
    return g.nodes.select("name").join(g.edges.select(F.col("source").alias("name")), "name", "left_anti")


def isolated(g: Graph) -> DataFrame:
    return roots(g).join(leaves(g), "name", "left_semi")


def tables_by_layer(g: Graph) -> DataFrame:
    return g.nodes.groupBy("layer").agg(F.sort_array(F.collect_list("name")).alias("tables"))


def _pairs(g: Graph, up: bool) -> DataFrame:
    e = g.edges.select("source", "target")
    return e.select(F.col("target" if up else "source").alias("a"), F.col("source" if up else "target").alias("b")).distinct()


def _near(pairs: Iterable[tuple[str, str]], up: bool = False) -> dict[str, list[str]]:
    """The neighbours of each node of a small graph, in order of their names."""
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in pairs:
        if up:
            a, b = b, a
        out[a].append(b)
    return {n: sorted(x) for n, x in out.items()}


def _frame(g: Graph, rows: Iterable[tuple], schema: str) -> DataFrame:
    return local_frame(g.edges.sparkSession, list(rows), schema)


# ---- traversals


def _hops(near: dict[str, list[str]], start: str, depth: int | None = None) -> dict[str, int]:
    """The fewest hops from a node of a small graph to each other one, itself included."""
    hops, front = {start: 0}, [start]
    while front and (depth is None or hops[front[0]] < depth):
        reached = []
        for node in front:
            for other in near.get(node, ()):
                if other not in hops:
                    hops[other] = hops[node] + 1
                    reached.append(other)
        front = reached
    return hops


def levels(g: Graph, start: str, up: bool = False, depth: int | None = None) -> DataFrame:
    """(name, level) of everything reachable, by the fewest hops; the start itself is left out."""
    spark = g.edges.sparkSession
    if (pairs := g.pairs()) is not None:
        return _frame(g, ((n, k) for n, k in _hops(_near(pairs, up), start, depth).items() if k), "name string, level int")
    e = _kept(_pairs(g, up))
    seen = spark.createDataFrame([(start, 0)], "name string, level int")
    front, k = seen, 0
    while depth is None or k < depth:
        k += 1
        front = _kept(front.join(e, front["name"] == e["a"]).select(F.col("b").alias("name")).distinct().join(seen.select("name"), "name", "left_anti").withColumn("level", F.lit(k)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen.where("level > 0")


def closure(g: Graph) -> DataFrame:
    """(a, b): b is reachable from a in one hop or more. Semi-naive: only new pairs are extended, by doubling."""
    e = _kept(_pairs(g, False))
    seen, front = e, e
    while front.limit(1).count():
        step = front.join(seen.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        step = step.unionByName(seen.select("a", F.col("b").alias("m")).join(front.select(F.col("a").alias("m"), F.col("b").alias("c")), "m").select("a", F.col("c").alias("b")))
        front = _kept(step.distinct().join(seen, ["a", "b"], "left_anti"))
        seen = _kept(seen.unionByName(front))
    return seen


def _ways(near: dict[str, list[str]], start: str, hops: int, to_go: dict[str, int] | None = None) -> Iterator[list[str]]:
    """Simple paths of exactly ``hops`` hops in order of their names; with ``to_go`` (hops still needed at least) only those
    that can still end in time. Ends after TRIED extensions."""
    path, inside, open_, tried = [start], {start}, [iter(near.get(start, ()))], 0
    if hops == 0:
        yield [start]
        return
    while open_:
        node = next(open_[-1], None)
        if node is None:
            open_.pop()
            inside.discard(path.pop())
            continue
        tried += 1
        if tried > TRIED:
            return
        if node in inside or to_go is not None and to_go.get(node, hops) > hops - len(path):
            continue
        if len(path) == hops:
            yield [*path, node]
        else:
            path.append(node)
            inside.add(node)
            open_.append(iter(near.get(node, ())))


def _recursive(g: Graph, up: bool, start: str, most: int, until: str = "") -> tuple[DataFrame, DataFrame]:
    """All simple paths (path, last, hops) of a large graph's part around a table, and the edges (a, b) used. A part
    with more paths than Spark's recursion limit of rows raises an error."""
    spark = g.edges.sparkSession
    e = _kept(_pairs(g, up))
    view = f"weftline_{uuid.uuid4().hex}"
    e.createOrReplaceTempView(view)
    try:
        rows = spark.sql(
            f"""WITH RECURSIVE p(path, last, hops) AS (
                  SELECT array(:start), CAST(:start AS STRING), 0
                  UNION ALL SELECT concat(path, array(e.b)), e.b, hops + 1 FROM p JOIN {view} e ON e.a = p.last
                    WHERE NOT array_contains(path, e.b) AND hops < {int(most)} AND p.last <> :until)
                SELECT path, hops, last FROM p""",
            args={"start": start, "until": until},
        )
        return _kept(rows.where("hops > 0")), e
    finally:
        spark.catalog.dropTempView(view)


def paths(g: Graph, start: str, up: bool = False, depth: int | None = None, max_paths: int = MAX_PATHS, max_length: int = MAX_LENGTH) -> DataFrame:
    """Longest simple paths from a table, (path, hops), at most ``max_paths`` by (hops, path). Of a graph whose short paths
    alone pass TRIED, those that were found till then."""
    most = min(max_length, depth if depth is not None else max_length)
    if (pairs := g.pairs()) is not None:
        near, found = _near(pairs, up), []
        for hops in range(1, most + 1):
            for path in _ways(near, start, hops):
                if hops == most or all(n in path for n in near.get(path[-1], ())):
                    found.append((path, hops))
                    if len(found) == max_paths:
                        return _frame(g, found, "path array<string>, hops int")
        return _frame(g, found, "path array<string>, hops int")
    rows, e = _recursive(g, up, start, most)
    more = rows.where(F.col("hops") < most).join(e, F.col("last") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("path").distinct()
    return rows.join(more, "path", "left_anti").select("path", "hops").orderBy("hops", "path").limit(max_paths)


def paths_between(g: Graph, source: str, target: str, max_paths: int = MAX_PATHS_BETWEEN, max_length: int = MAX_LENGTH) -> DataFrame:
    """All simple paths of at most ``max_length`` hops, (path, n_nodes), shortest first."""
    schema = "path array<string>, n_nodes int"
    if source == target:
        return _frame(g, [([source], 1)], schema)
    if (pairs := g.pairs()) is not None:
        near, to_go = _near(pairs), _hops(_near(pairs, True), target, max_length)
        near = {a: [b for b in x if b in to_go] for a, x in near.items() if a != target}
        found = []
        for hops in range(1, max_length + 1):
            for path in _ways(near, source, hops, to_go):
                if path[-1] == target:
                    found.append((path, hops + 1))
                    if len(found) == max_paths:
                        return _frame(g, found, schema)
        return _frame(g, found, schema)
    rows, _ = _recursive(g, False, source, max_length, target)
    return rows.where(F.col("last") == target).select("path", F.size("path").alias("n_nodes")).orderBy("n_nodes", "path").limit(max_paths)


def shortest(g: Graph, source: str, target: str) -> int | None:
    """The number of nodes on a shortest path."""
    if source == target:
        return 1
    got = levels(g, source).where(F.col("name") == target).first()
    return got.level + 1 if got else None


def impact(g: Graph, table: str, up: bool = False, depth: int | None = None, max_paths: int = MAX_PATHS) -> dict:
    """Levels, tables, edges among them, paths and ends of what lies up- or downstream of a table."""
    name = resolve(g, table)
    if name is None:
        return {"found": False, "candidates": sorted(r.name for r in candidates(g, table).collect())}
    lv = _kept(levels(g, name, up, depth))
    inside = lv.select("name").union(g.edges.sparkSession.createDataFrame([(name,)], "name string"))
    sub = subgraph(g, inside)
    by_level: dict[int, list[str]] = {}
    for r in lv.orderBy("level", "name").collect():
        by_level.setdefault(r.level, []).append(r.name)
    found = [r.path for r in paths(g, name, up, depth, max_paths).collect()] if max_paths else []
    return {
        "found": True, "table": name, "levels": by_level, "tables": [t for x in by_level.values() for t in x],
        "edges": sorted((r.source, r.target) for r in sub.edges.select("source", "target").collect()),
        "roots": sorted(r.name for r in roots(sub).collect()), "leaves": sorted(r.name for r in leaves(sub).collect()), "paths": found, "paths_truncated": bool(max_paths) and len(found) == max_paths,
    }


def subgraph(g: Graph, names: DataFrame) -> Graph:
    """The nodes named and the edges among them."""
    n = names.select("name").distinct()
    e = g.edges.join(n.withColumnRenamed("name", "source"), "source", "left_semi").join(n.withColumnRenamed("name", "target"), "target", "left_semi")
    return Graph(g.nodes.join(n, "name", "left_semi"), e)


def focus(g: Graph, table: str, depth: int | None = None) -> Graph:
    """A table, all above and all below it."""
    me = g.edges.sparkSession.createDataFrame([(table,)], "name string")
    return subgraph(g, me.union(levels(g, table, True, depth).select("name")).union(levels(g, table, False, depth).select("name")))


# ---- cycles, order, depth


def _trim(e: DataFrame) -> DataFrame:
    e = _kept(e)
    n = e.count()
    while n:
        fed = e.select(F.col("target").alias("source")).distinct()
        read = e.select(F.col("source").alias("target")).distinct()
        e = _kept(e.join(fed, "source", "left_semi").join(read, "target", "left_semi").select("source", "target"))
        n, old = e.count(), n
        if n == old:
            break
    return e


def core(g: Graph) -> Graph:
    """What is left when tables without sources and tables without readers are taken away again and again: cycles and the
    ways between them. An acyclic graph has an empty core."""
    return Graph(g.nodes, _trim(g.edges.select("source", "target").distinct()))


def _components(near: dict[str, list[str]]) -> dict[str, str]:
    """Of each node of a small graph the smallest node of its strongly connected component (two depth-first passes)."""
    back: dict[str, list[str]] = defaultdict(list)
    for a, x in near.items():
        for b in x:
            back[b].append(a)
    done, finished = set(), []
    for start in sorted({*near, *back}):
        if start in done:
            continue
        done.add(start)
        open_ = [(start, iter(near.get(start, ())))]
        while open_:
            node, rest = open_[-1]
            nxt = next((n for n in rest if n not in done), None)
            if nxt is None:
                finished.append(node)
                open_.pop()
            else:
                done.add(nxt)
                open_.append((nxt, iter(near.get(nxt, ()))))
    out: dict[str, str] = {}
    for start in reversed(finished):
        if start in out:
            continue
        members, todo = {start}, [start]
        while todo:
            for n in back.get(todo.pop(), ()):
                if n not in out and n not in members:
                    members.add(n)
                    todo.append(n)
        out |= dict.fromkeys(members, min(members))
    return out


def _colour(e: DataFrame) -> DataFrame:
    """(name, component) of the nodes of a core, by colouring: every node takes the smallest name that reaches it; the nodes
    that reach the one of that name within its colour are its component. Those go, the rest is trimmed and coloured again."""
    found = None
    while e.limit(1).count():
        colour = _kept(e.select(F.col("source").alias("name")).union(e.select("target")).distinct().withColumn("c", F.col("name")))
        front = colour
        while front.limit(1).count():
            said = e.join(front, e["source"] == front["name"]).groupBy("target").agg(F.min("c").alias("new"))
            both = _kept(colour.join(said, colour["name"] == said["target"], "left").select("name", "c", F.least("c", "new").alias("new")))
            colour = both.select("name", F.col("new").alias("c"))
            front = both.where("new < c").select("name", F.col("new").alias("c"))
        colour = _kept(colour)
        same = e.join(colour.withColumnRenamed("name", "source"), "source").join(colour.select(F.col("name").alias("target"), F.col("c").alias("d")), "target").where("c = d")
        same = _kept(same.select("source", "target", "c"))
        own = front = colour.where("name = c")
        while front.limit(1).count():
            step = same.join(front.withColumnRenamed("name", "target"), ["target", "c"]).select(F.col("source").alias("name"), "c").distinct()
            front = _kept(step.join(own, "name", "left_anti"))
            own = own.unionByName(front)
        own = _kept(own)
        found = own if found is None else found.unionByName(own)
        e = _trim(e.join(own.select(F.col("name").alias("source")), "source", "left_anti").join(own.select(F.col("name").alias("target")), "target", "left_anti"))
    return found


def scc(g: Graph) -> DataFrame:
    """(name, component, size): strongly connected components, named by their smallest member. In large graphs they are
    looked for in the core alone."""
    if (pairs := g.pairs()) is not None:
        own = _frame(g, ((n, c) for n, c in _components(_near(pairs)).items() if n != c), "name string, m string")
    else:
        found = _colour(core(g).edges)
        own = found.withColumnRenamed("c", "m") if found is not None else _frame(g, [], "name string, m string")
    x = g.nodes.select("name").join(own, "name", "left").select("name", F.coalesce("m", "name").alias("component"))
    return x.join(x.groupBy("component").agg(F.count("*").alias("size")), "component").select("name", "component", "size")


def cycles(g: Graph) -> DataFrame:
    """(component, nodes, length): components of several nodes and nodes that feed themselves."""
    if (pairs := g.pairs()) is not None:
        members: dict[str, list[str]] = defaultdict(list)
        for n, c in _components(_near(pairs)).items():
            members[c].append(n)
        own = {a for a, b in pairs if a == b}
        rows = sorted((len(x), c, sorted(x)) for c, x in members.items() if len(x) > 1 or c in own)
        return _frame(g, ((c, x, k) for k, c, x in rows), "component string, nodes array<string>, length long")
    own = g.edges.where("source = target").select(F.col("source").alias("name")).distinct().withColumn("self", F.lit(True))
    x = scc(g).join(own, "name", "left").where("size > 1 or self")
    return x.groupBy("component").agg(F.sort_array(F.collect_list("name")).alias("nodes"), F.count("*").alias("length")).orderBy("length", "component")


def cycle_path(g: Graph, component: str) -> list[str]:
    """One cycle through the component's smallest node, its first node repeated at the end."""
    into = [r.source for r in g.edges.where(F.col("target") == component).select("source").collect()]
    if component in into:
        return [component, component]
    own = _kept(levels(g, component))
    back = own.where(F.col("name").isin(into)).orderBy("level", "name").first()
    if back is None:
        return []
    return [*paths_between(g, component, back.name, 1).first().path, component]


def condensed(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(name, component) and the edges between different components."""
    c = _kept(scc(g).select("name", "component"))
    e = g.edges.select("source", "target").join(c.select(F.col("name").alias("source"), F.col("component").alias("a")), "source").join(c.select(F.col("name").alias("target"), F.col("component").alias("b")), "target")
    return c, _kept(e.where("a <> b").select("a", "b").distinct())


def _longest(near: dict[str, list[str]], component: dict[str, str]) -> dict[str, int]:
    """Of each component of a small graph the most hops from a root to it (its nodes taken as one)."""
    of = lambda n: component.get(n, n)
    out: dict[str, set[str]] = defaultdict(set)
    waits: dict[str, int] = defaultdict(int)
    for a, x in near.items():
        for b in x:
            if of(a) != of(b) and of(b) not in out[of(a)]:
                out[of(a)].add(of(b))
                waits[of(b)] += 1
    depth = {c: 0 for c in {*out, *waits}}
    ready = [c for c in depth if not waits[c]]
    while ready:
        c = ready.pop()
        for b in out.get(c, ()):
            depth[b] = max(depth[b], depth[c] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return depth


def depths(g: Graph) -> DataFrame:
    """(name, depth): the longest way from a root, cycles taken as one node. In large graphs only components whose depth
    has just grown are followed further."""
    if (pairs := g.pairs()) is not None:
        near = _near(pairs)
        component = _components(near)
        depth = _longest(near, component)
        deep = _frame(g, ((n, d) for n in component if (d := depth.get(component[n], 0))), "name string, d int")
        return g.nodes.select("name").join(deep, "name", "left").select("name", F.coalesce("d", F.lit(0)).alias("depth"))
    return _deep(*condensed(g))


def _deep(c: DataFrame, e: DataFrame) -> DataFrame:
    d = _kept(c.select("component").distinct().withColumn("depth", F.lit(0)))
    front = d
    while front.limit(1).count():
        new = e.join(front, e["a"] == front["component"]).groupBy("b").agg((F.max("depth") + 1).alias("n"))
        both = _kept(d.join(new, d["component"] == new["b"], "left").select("component", "depth", F.greatest("depth", F.coalesce("n", F.lit(0))).alias("n")))
        d = both.select("component", F.col("n").alias("depth"))
        front = both.where("n > depth").select("component", F.col("n").alias("depth"))
    return c.join(d, "component").select("name", "depth")


def topological_levels(g: Graph) -> DataFrame:
    """(name, level) of an acyclic graph; no rows where it has a cycle."""
    if g.pairs() is not None:
        found = depths(g)
        cyclic = any(a == b for a, b in g.pairs()) or any(n != c for n, c in _components(_near(g.pairs())).items())
    else:
        c, e = condensed(g)
        found = _deep(c, e)
        cyclic = g.edges.where("source = target").limit(1).count() or c.where("name <> component").limit(1).count()
    return found.withColumnRenamed("depth", "level").where("false" if cyclic else "true")


def topological_order(g: Graph) -> list[str] | None:
    """The smallest order by name in which every table follows its sources (for graphs that fit the driver)."""
    import heapq

    names = [r.name for r in g.nodes.select("name").collect()]
    into, out = dict.fromkeys(names, 0), {n: [] for n in names}
    for r in g.edges.select("source", "target").distinct().collect():
        into[r.target] += 1
        out[r.source].append(r.target)
    heap, order = [n for n in names if not into[n]], []
    heapq.heapify(heap)
    while heap:
        n = heapq.heappop(heap)
        order.append(n)
        for t in out[n]:
            into[t] -= 1
            if not into[t]:
                heapq.heappush(heap, t)
    return order if len(order) == len(names) else None


def stats(g: Graph) -> dict:
    """Counts of the graph; one row of aggregates each."""
    n, e = g.nodes, g.edges
    deg = degrees(g).agg(F.max("in_degree").alias("i"), F.max("out_degree").alias("o"), F.round(F.avg("out_degree"), 3).alias("avg"), F.count("*").alias("n"), F.count_if(F.col("in_degree") == 0).alias("roots"), F.count_if(F.col("out_degree") == 0).alias("leaves"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("alone")).first()
    per = {r.layer: r["count"] for r in n.groupBy("layer").count().collect()}
    has = "column_mappings" in e.columns
    c = e.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) if has else F.lit(0).alias(x) for x in ("column_mappings", "unresolved_mappings", "constant_mappings")]).first()
    cyc = cycles(g).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
    return {
        "tables": deg.n, "edges": c.n, "roots": deg.roots, "leaves": deg.leaves, "isolated": deg.alone, "max_in_degree": deg.i or 0, "max_out_degree": deg.o or 0, "avg_out_degree": deg.avg or 0.0,
        "column_mappings": c.column_mappings, "unresolved_mappings": c.unresolved_mappings, "constant_mappings": c.constant_mappings, "cycles": cyc.n, "tables_in_cycles": cyc.t,
        "max_depth": depths(g).agg(F.max("depth")).first()[0] or 0, "layers": {x: per[x] for x in LAYERS if x in per},
    }


# ---- sources and sinks


def save(g: Graph, path: str) -> None:
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def to_dict(g: Graph) -> dict:
    """For graphs that fit the driver."""
    return {"schema_version": 1, "nodes": [r.asDict(True) for r in g.nodes.orderBy("name").collect()], "edges": [r.asDict(True) for r in g.edges.orderBy("source", "target").collect()]}


def from_dict(spark: SparkSession, d: dict, like: Graph) -> Graph:
    def rows(data, schema):
        return spark.createDataFrame([tuple(x.get(n) for n in schema.fieldNames()) for x in data], schema)

    return Graph(rows(d["nodes"], like.nodes.schema), rows(d["edges"], like.edges.schema))


def mermaid(g: Graph, highlight: str | None = None, direction: str = "LR", depth: int | None = None, group_layers: bool = False) -> str:
    """A flowchart of the graph, with the highlighted table's sides marked; with ``depth`` only what lies so many hops around
    that table, with ``group_layers`` a box for each layer."""
    if highlight and not g.nodes.where(F.col("name") == highlight).limit(1).count():
        raise ValueError(f"no such table: {highlight}")
    if highlight and depth is not None:
        g = focus(g, highlight, depth)
    up = {r.name for r in levels(g, highlight, True).collect()} if highlight else set()
    down = {r.name for r in levels(g, highlight).collect()} if highlight else set()
    nodes = g.nodes.select("name", "layer").orderBy("layer", "name").collect()
    ids = {r.name: f"n{i}" for i, r in enumerate(nodes)}
    out, layer = [f"flowchart {direction}"], None
    for r in nodes:
        if group_layers and r.layer != layer:
            out += ["  end"] * (layer is not None) + [f"  subgraph {r.layer}"]
            layer = r.layer
        mark = ":::center" if r.name == highlight else ":::up" if r.name in up else ":::down" if r.name in down else ""
        out.append(f'  {ids[r.name]}["{r.name.replace(chr(34), "&quot;")}"]{mark}')
    out += ["  end"] * (layer is not None)
    out += [f"  {ids[r.source]} --> {ids[r.target]}" for r in g.edges.select("source", "target").distinct().orderBy("source", "target").collect()]
    if highlight:
        out += ["  classDef center fill:#f96", "  classDef up fill:#9cf", "  classDef down fill:#cf9"]
    return "\n".join(out)


# ---- text


def impact_text(found: dict) -> str:
    """The result of ``impact`` as lines."""
    if not found["found"]:
        return "no such table" + (f"; did you mean {', '.join(found['candidates'])}?" if found["candidates"] else "")
    out = [f"{found['table']}: {len(found['tables'])} tables in {len(found['levels'])} levels"]
    out += [f"  {k}: {', '.join(v)}" for k, v in sorted(found["levels"].items())]
    out += ["  " + " -> ".join(p) for p in found["paths"]]
    return "\n".join(out + (["  (more paths not listed)"] if found["paths_truncated"] else []))


def cycles_text(rows: list) -> str:
    return "\n".join(" -> ".join([*r.nodes, r.nodes[0]]) for r in rows) or "no cycles"


def stats_text(s: dict) -> str:
    return "\n".join(f"{k}: {', '.join(f'{a} {b}' for a, b in v.items()) if isinstance(v, dict) else v}" for k, v in s.items())
