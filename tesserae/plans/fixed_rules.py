"""Fixed rules by name: graph algorithms, readers and utilities, called with relations and options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.scalar import Compiler
from tesserae.operators import graph
from tesserae.plans import ir
from tesserae.plans.compiler import col, literal_rows
from tesserae.plans.ir import EngineError
from tesserae.plans.parser import constant
from tesserae.sources import readers


@dataclass
class Call:
    """A call's inputs (columns named by the caller's variables) and options."""

    spark: object
    name: str
    inputs: list[DataFrame]
    options: dict

    def input(self, i: int, needed: bool = True) -> DataFrame | None:
        if i < len(self.inputs):
            return self.inputs[i]
        if needed:
            raise EngineError("fixed_rule::input", f"{self.name} takes more relations")
        return None

    def get(self, name: str, default=..., kind=None, least=None, most=None):
        if name not in self.options:
            if default is ...:
                raise EngineError("fixed_rule::option", f"{self.name} needs the option {name}")
            return default
        v = constant(self.options[name])
        if kind is bool and not isinstance(v, bool) or kind in (int, float) and (isinstance(v, bool) or not isinstance(v, (int, float))) or kind is int and int(v) != v or kind is str and not isinstance(v, str):
            raise EngineError("fixed_rule::option", f"the option {name} of {self.name} is a {kind.__name__}")
        if least is not None and v < least or most is not None and v > most:
            raise EngineError("fixed_rule::option", f"the option {name} of {self.name} is out of range")
        return kind(v) if kind in (int, float) else v

    def condition(self, name: str) -> Callable:
        if name not in self.options:
            raise EngineError("fixed_rule::option", f"{self.name} needs the option {name}")
        return lambda df: Compiler(df).column(self.options[name])


def flag(c: Call, name="undirected") -> bool:
    return c.get(name, False, bool)


def reorder_sort(c: Call) -> DataFrame:
    """Rank and columns; ranks of ties are equal unless break_ties. Ordered ranges are numbered apart, not in one task."""
    df = c.input(0)
    comp = Compiler(df)
    out = c.options.get("out")
    if not isinstance(out, ir.Items):
        raise EngineError("fixed_rule::option", "ReorderSort needs a list `out`")
    sort = c.options.get("sort_by")
    keys = list(sort.args) if isinstance(sort, ir.Items) else [sort] if sort is not None and not (isinstance(sort, ir.Lit) and sort.value is None) else []
    down, skip, take = flag(c, "descending"), c.get("skip", 0, int, 0), c.get("take", 0, int, 0)
    rows = df.select(*[comp.column(k).alias(f"__s{i}") for i, k in enumerate(keys)], *[comp.column(e).alias(f"__o{i}") for i, e in enumerate(out.args)])
    order = [(f"__s{i}", down) for i in range(len(keys))] + [(f"__o{i}", False) for i in range(len(out.args))]
    limit = skip + take if take else None
    columns = [F.col(n).desc() if d else F.col(n).asc() for n, d in order]
    if limit is not None:
        rows = rows.orderBy(*columns).limit(limit)  # a top-k, then few rows
    from tesserae.operators.graph import numbered

    n = numbered(rows, [], columns, "__n") if limit is None else rows.withColumn("__n", (F.row_number().over(Window.orderBy(*columns)) - 1).cast("long"))
    if flag(c, "break_ties") or not keys:
        n = n.withColumn("rank", F.col("__n") + 1)
    else:
        sorts = [F.col(f"__s{i}") for i in range(len(keys))]
        first = n.groupBy(*[s.alias(f"__t{i}") for i, s in enumerate(sorts)]).agg((F.min("__n") + 1).alias("rank"))
        same = F.lit(True)
        for i, s in enumerate(sorts):
            same = same & s.eqNullSafe(F.col(f"__t{i}"))
        n = n.join(first, same)
    n = n.where((F.col("__n") >= skip) & (F.col("__n") < (limit if limit is not None else (1 << 62))))
    return n.select(F.col("rank").cast("long"), *[f"__o{i}" for i in range(len(out.args))])


def a_star(c: Call) -> DataFrame:
    """Values of the heuristic, an expression over a node's and a goal's columns, are made for the pairs asked for."""
    nodes, starts, goals = c.input(1), c.input(2), c.input(3)
    goal_nodes = nodes.join(graph.one(goals, "__g"), col(nodes.columns[0]) == F.col("__g"), "left_semi")
    renamed = goal_nodes.toDF(*[f"{n}" if n not in nodes.columns else f"goal_{n}" for n in goal_nodes.columns])
    if goals.columns[0] not in renamed.columns:
        renamed = renamed.withColumn(goals.columns[0], col(renamed.columns[0]))
    pairs = nodes.crossJoin(renamed)
    h = Compiler(pairs).column(c.options["heuristic"]) if "heuristic" in c.options else None
    if h is None:
        raise EngineError("fixed_rule::option", "ShortestPathAStar needs the option heuristic")
    return graph.a_star(c.input(0), starts, goals, pairs.select(col(nodes.columns[0]).alias("node"), col(renamed.columns[0]).alias("goal"), h.alias("h")))


def searched(fn):
    def run(c: Call) -> DataFrame:
        return fn(c.input(0), c.input(1), c.input(2, False) if len(c.inputs) > 2 else c.input(1), c.condition("condition"), c.get("limit", 1, int, 1))

    return run


def random_walk(c: Call) -> DataFrame:
    edges = c.input(0)
    if "weight" in c.options:
        edges = edges.select(col(edges.columns[0]), col(edges.columns[1]), Compiler(edges).column(c.options["weight"]).alias("__w"))
    return graph.random_walk(edges, c.input(2), c.get("steps", kind=int, least=1), c.get("iterations", 1, int, 1))


def constant_relation(c: Call) -> DataFrame:
    rows = c.get("data")
    if not isinstance(rows, list) or len({len(r) if isinstance(r, list) else 1 for r in rows}) > 1:
        raise EngineError("parser::const", "Constant takes rows of one length")
    rows = [r if isinstance(r, list) else [r] for r in rows]
    return literal_rows(c.spark, rows, len(rows[0]) if rows else 0)


def prim(c: Call) -> DataFrame:
    """The tree of the component that holds the start: of the forest, what is connected with it."""
    forest = graph.cut(graph.minimum_spanning_forest(c.input(0)))
    start = c.input(1, False)
    if start is None:
        start = forest.agg(F.min("from").alias("s")).where("s is not null")
    both = forest.select("from", "to")
    found = graph.reachable(both.unionAll(both.select("to", "from")), start).select(F.col("node").alias("__n"))
    return forest.join(found, F.col("from") == F.col("__n"), "left_semi")


RULES: dict[str, Callable[[Call], DataFrame]] = {
    "DegreeCentrality": lambda c: graph.degree_centrality(c.input(0), c.input(1, False)),
    "ClosenessCentrality": lambda c: graph.closeness_centrality(c.input(0), flag(c)),
    "BetweennessCentrality": lambda c: graph.betweenness_centrality(c.input(0), flag(c)),
    "DepthFirstSearch": searched(graph.depth_first),
    "DFS": searched(graph.depth_first),
    "BreadthFirstSearch": searched(graph.breadth_first),
    "BFS": searched(graph.breadth_first),
    "ShortestPathBFS": lambda c: graph.shortest_path_bfs(c.input(0), c.input(1), c.input(2)),
    "ShortestPathDijkstra": lambda c: graph.shortest_paths(c.input(0), c.input(1), c.input(2, False), flag(c), flag(c, "keep_ties")),
    "ShortestPathAStar": a_star,
    "KShortestPathYen": lambda c: graph.k_shortest_paths(c.input(0), c.input(1), c.input(2), c.get("k", kind=int, least=1), flag(c)),
    "MinimumSpanningTreePrim": prim,
    "MinimumSpanningForestKruskal": lambda c: graph.minimum_spanning_forest(c.input(0)),
    "TopSort": lambda c: graph.top_sort(c.input(0)),
    "ConnectedComponents": lambda c: graph.connected_components(c.input(0), c.input(1, False)),
    "StronglyConnectedComponents": lambda c: graph.strongly_connected_components(c.input(0), c.input(1, False)),
    "SCC": lambda c: graph.strongly_connected_components(c.input(0), c.input(1, False)),
    "PageRank": lambda c: graph.pagerank(c.input(0), flag(c), c.get("theta", 0.85, float, 0, 1), c.get("epsilon", 1e-4, float, 0), c.get("iterations", 10, int, 1)),
    "ClusteringCoefficients": lambda c: graph.clustering(c.input(0)),
    "CommunityDetectionLouvain": lambda c: graph.louvain(c.input(0), flag(c), c.get("max_iter", 10, int, 1), c.get("delta", 1e-4, float, 0), c.get("keep_depth", None, int, 1)),
    "LabelPropagation": lambda c: graph.label_propagation(c.input(0), flag(c), c.get("max_iter", 10, int, 1)),
    "RandomWalk": random_walk,
    "ReorderSort": reorder_sort,
    "Constant": constant_relation,
    "CsvReader": lambda c: readers.read_csv(c.spark, c.get("url", kind=str), c.get("types"), c.get("delimiter", ",", str), c.get("has_headers", True, bool), c.get("prepend_index", False, bool)),
    "JsonReader": lambda c: readers.read_json(c.spark, c.get("url", kind=str), c.get("fields"), c.get("json_lines", True, bool), c.get("null_if_absent", False, bool), c.get("prepend_index", False, bool)),
}

#: Rules whose rows are distinct by construction.
DISTINCT = frozenset(RULES) - {"ReorderSort", "Constant", "CsvReader", "JsonReader"}
