"""Graph algorithms over edge DataFrames (src, dst[, weight]).

Traversals, ranks, components and forests are loops of joins and partial aggregates, each round
written to the shared folder, and its end decided by what was counted while it was written. Algorithms
that follow one path at a time (depth-first search, A*, Yen's, Brandes' betweenness, Louvain's moves)
run per source over a broadcast of the graph, whose size is checked: beyond MOST_EDGES they raise.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.plans.ir import EngineError
from tesserae.storage import counted, cut, discard

#: Edges that a broadcast graph, or a graph in one task, may have.
MOST_EDGES = 5_000_000


def edges_of(df: DataFrame, undirected: bool = False, negative: bool = False) -> DataFrame:
    """(src, dst, weight): weight 1.0 where there is none; both directions if undirected."""
    names = df.columns
    w = F.col(f"`{names[2]}`").cast("double") if len(names) > 2 else F.lit(1.0)
    out = df.select(F.col(f"`{names[0]}`").alias("src"), F.col(f"`{names[1]}`").alias("dst"), w.alias("weight"))
    if len(names) > 2:
        bad = F.isnan("weight") | F.col("weight").isNull() | (F.abs("weight") == F.lit(math.inf)) | (F.lit(not negative) & (F.col("weight") < 0))
        out = out.withColumn("weight", F.when(bad, F.raise_error(F.lit("an edge's weight is negative or not finite")).cast("double")).otherwise(F.col("weight")))
    return both_ways(out) if undirected else out


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def nodes_of(e: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    out = e.select(F.col("src").alias("node")).unionAll(e.select("dst"))
    if nodes is not None:
        out = out.unionAll(nodes.select(F.col(f"`{nodes.columns[0]}`").alias("node")))
    return out.distinct()


def one(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(f"`{df.columns[0]}`").alias(name)).distinct()


# --- whole-graph measures -----------------------------------------------------------------------------


def degree_centrality(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    e = edges_of(edges)
    # both ends of an edge in one pass: a union would make the edges twice
    end = lambda c, o, i: F.struct(F.col(c).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    parts = e.select(F.explode(F.array(end("src", 1, 0), end("dst", 0, 1))).alias("end")).select("end.*")
    if nodes is not None:
        parts = parts.unionAll(nodes.select(F.col(f"`{nodes.columns[0]}`"), F.lit(0), F.lit(0)))
    return parts.groupBy("node").agg(F.sum(F.col("o") + F.col("i")).alias("total"), F.sum("o").alias("out"), F.sum("i").alias("in"))


def in_one_task(e: DataFrame, run, schema: str) -> DataFrame:
    """run(source numbers, destination numbers, node names) -> (columns of the result) over edges (src, dst), whose number
    the caller has checked: arrays in one task in place of a job for each round."""
    kind = e.schema["src"].dataType.simpleString()
    schema = schema.format(node=kind)
    names = [x.split()[0] for x in schema.split(", ")]

    def over(table: pa.Table) -> pa.Table:
        both = pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks]).combine_chunks().dictionary_encode(null_encoding="encode")
        code = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = table.num_rows
        return pa.table(run(code[:n], code[n:], both.dictionary), names=names)

    return e.select("src", "dst", F.lit(0).alias("_all")).groupBy("_all").applyInArrow(over, schema)


def pagerank(edges: DataFrame, undirected: bool = False, theta: float = 0.85, epsilon: float = 1e-4, iterations: int = 10) -> DataFrame:
    """Rank (1 - theta) / n plus theta times what in-neighbours pass on; dangling ranks are not dealt out anew.

    A round is one aggregate over the edges, summed before its shuffle, and one job: how far ranks
    moved is seen while they are written. At most MOST_EDGES edges are arrays in one task instead.
    """
    e, n_edges = counted(edges_of(edges, undirected).select("src", "dst"))

    def arrays(src, dst, nodes):
        n = len(nodes)
        share, ranks = 1.0 / np.maximum(np.bincount(src, minlength=n), 1), np.full(n, 1.0 / n)
        for _ in range(iterations):
            new = (1 - theta) / n + theta * np.bincount(dst, weights=(ranks * share)[src], minlength=n)
            moved, ranks = float(np.abs(new - ranks).sum()), new
            if moved < epsilon:
                break
        return [nodes, pa.array(ranks)]

    if n_edges <= MOST_EDGES:
        return in_one_task(e, arrays, "node {node}, rank double")
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    e = cut(e.join(degree, "src"))
    nodes, n = counted(nodes_of(e))
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        passed = ranks.join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        got = F.lit((1 - theta) / n) + F.lit(theta) * F.coalesce("got", F.lit(0.0))
        new = ranks.join(passed, F.col("node") == F.col("dst"), "left").select("node", got.alias("rank"), F.abs(got - F.col("rank")).alias("moved"))
        new = cut(new, moved=F.sum("moved"))
        if i:
            discard(before)  # noqa: F821
        before, ranks = new, new.select("node", "rank")
        if new.seen["moved"] < epsilon:
            break
    return ranks


#: Edges that a task looks pairs of neighbours up in, edges whose pairs it spells out, and pairs looked up at once.
CLOSING_EDGES, PAIRED_EDGES, PAIRS = 4_000_000, 2_000_000, 1 << 20


def clustering(edges: DataFrame) -> DataFrame:
    """node, cc, triangles, degree of an undirected graph; parallel edges count once.

    Triangles are listed once each, edges directed from smaller degree to larger, so a hub's pairs
    of neighbours are not spelled out.
    """
    e = edges_of(edges).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = cut(e)
    degree = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    degree = cut(degree)
    d = degree.select(F.col("node").alias("n"), F.col("degree").alias("d"))
    o = e.join(d, F.col("a") == F.col("n")).withColumnRenamed("d", "da").drop("n").join(d, F.col("b") == F.col("n")).withColumnRenamed("d", "db").drop("n")
    forward = (F.col("da") < F.col("db")) | (F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))
    o, n_edges = counted(o.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v")))
    count = triangles_of(o, n_edges).groupBy("node").agg(F.sum("t").alias("t"))
    out = degree.join(count, "node", "left").withColumn("n_triangles", F.coalesce("t", F.lit(0)).cast("long"))
    cc = F.when(F.col("degree") > 1, 2.0 * F.col("n_triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0))
    return out.select("node", cc.alias("cc"), "n_triangles", "degree")


def triangles_of(o: DataFrame, n_edges: int) -> DataFrame:
    """(node, t): triangles of a graph's edges o(u, v), directed without a cycle; a node has several rows.

    A triangle is a pair of edges out of its first node and the edge that closes it, one between nodes with edges in.
    Nodes have colours, and first nodes parts: the task of a pair of colours and a part holds the closing
    edges between these colours and the part's edges into them. It spells out pairs of edges some at a time and keeps
    sums alone, so that no pair is ever written or sent; an edge is sent once for each colour, a closing one once for each part.
    """
    inner = o.groupBy("v").agg(F.count(F.lit(1)).alias("into"))
    # the closing edge's source is the nearer of a pair, its end the farther, which then has two edges in at least
    last = inner.where("into > 1").select(F.col("v").alias("n"))
    closing = o.join(inner.select(F.col("v").alias("n")), F.col("u") == F.col("n"), "left_semi").join(last, F.col("v") == F.col("n"), "left_semi")
    closing, n_closing = counted(closing)
    colours = max(1, math.ceil(math.sqrt(2 * n_closing / CLOSING_EDGES)))
    couples = colours * (colours + 1) // 2
    parts = max(1, math.ceil(n_edges * colours / couples / PAIRED_EDGES), math.ceil(o.sparkSession.sparkContext.defaultParallelism / couples) if n_edges > PAIRED_EDGES // 8 else 1)
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    couple = lambda x, y: F.least(x, y) * F.lit(colours) + F.greatest(x, y)
    paired = o.withColumn("c", colour("v")).withColumn("part", F.pmod(F.xxhash64("u", F.lit(1)), F.lit(parts)).cast("int"))
    paired = paired.select("u", "v", "c", "part", F.explode(F.array(*[couple(F.col("c"), F.lit(i)) for i in range(colours)])).alias("task"))
    ends = closing.select("u", "v", couple(colour("u"), colour("v")).alias("task"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    kind = o.schema["u"].dataType.simpleString()

    def over(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = pa.chunked_array([*right.column("u").chunks, *right.column("v").chunks]).combine_chunks().unique() if right.num_rows else None
        if nodes is None or not left.num_rows:
            return pa.table([left.column("u").slice(0, 0), pa.array([], pa.int64())], names=["node", "t"])
        n, number = len(nodes), lambda c: pc.index_in(c.combine_chunks(), value_set=nodes)
        x, y = (number(right.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in "uv")
        known = np.sort(np.minimum(x, y) * n + np.maximum(x, y))
        v = number(left.column("v"))
        left, v = left.filter(pc.is_valid(v)), v.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = left.column("u").combine_chunks().dictionary_encode()
        u, c, names = firsts.indices.to_numpy(zero_copy_only=False).astype(np.int64), left.column("c").to_numpy(), firsts.dictionary
        order = np.lexsort((c, u))
        u, v, c = u[order], v[order], c[order]
        end = np.searchsorted(u, u, "right")
        # of one colour an edge is paired with those that follow, of two each of the first with all of the second
        low, high = divmod(int(left.column("task")[0].as_py()), colours) if left.num_rows else (0, 0)
        begin = np.arange(1, len(u) + 1) if low == high else np.where(c == low, np.searchsorted(u * 2 + (c == high), u * 2 + 1), end)
        sizes = end - begin
        sums, of_first, of_other = np.cumsum(sizes), np.zeros(len(names), np.int64), np.zeros(n, np.int64)
        at = 0
        while at < len(u):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
            one = np.repeat(np.arange(at, to), sizes[at:to])
            two = np.arange(len(one)) - np.repeat(sums[at:to] - sizes[at:to] - (sums[at - 1] if at else 0), sizes[at:to]) + begin[one]
            p, q = v[one], v[two]
            key = np.minimum(p, q) * n + np.maximum(p, q)
            hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            of_first += np.bincount(u[one[hit]], minlength=len(names))
            of_other += np.bincount(p[hit], minlength=n) + np.bincount(q[hit], minlength=n)
            at = to
        a, b = np.flatnonzero(of_first), np.flatnonzero(of_other)
        return pa.table([pa.chunked_array([names.take(pa.array(a)), nodes.take(pa.array(b))]), pa.array(np.concatenate([of_first[a], of_other[b]]))], names=["node", "t"])

    return paired.groupBy("task", "part").cogroup(ends.groupBy("task", "part")).applyInArrow(over, f"node {kind}, t long")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component: the smallest node reached. Large-star and small-star rounds."""
    e, n_edges = counted(edges_of(edges).select("src", "dst", "weight"))
    if n_edges <= MOST_EDGES:
        pairs = in_one_task(e, small_components, "u {node}, v {node}")
    else:
        pairs = smallest_reached(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    found = pairs.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return nodes_of(e, nodes).join(found, F.col("node") == F.col("_u"), "left").select("node", F.coalesce("_v", "node").alias("component"))


def small_components(src: np.ndarray, dst: np.ndarray, nodes: pa.Array) -> list[pa.Array]:
    """Each node and the smallest that it reaches: labels pass along all edges at once, and along themselves."""
    order = np.argsort(nodes.to_numpy(zero_copy_only=False), kind="stable") if nodes.null_count == 0 else np.array(sorted(range(len(nodes)), key=lambda i: (nodes[i].as_py() is not None, nodes[i].as_py())))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    a, b, label = rank[src], rank[dst], np.arange(len(order))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return [nodes.take(pa.array(order)), nodes.take(pa.array(order[label]))]


def smallest_reached(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(u, v): for each node of links(a, b) but the smallest of its component, that smallest one.

    Alternating large-star and small-star steps. Each is an aggregate (combined before the shuffle)
    joined back by node, a join whose large partitions Spark may split, so hubs do no harm.
    """
    pairs = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last, rounds = None, 0
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("w"), "m")
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(floor, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(floor.select(F.col("w"), F.col("m"))).distinct()
        new = cut(small, n=F.count(F.lit(1)), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        discard(pairs)
        pairs, now, rounds = new, (new.seen["n"], new.seen["h"]), rounds + 1
        if now == last:
            return pairs
        if rounds == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        last = now


def strongly_connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node): trim, colour forwards with the smallest ancestor, collect backwards."""
    e = edges_of(edges).select("src", "dst").where("src <> dst").distinct()
    all_nodes = nodes_of(edges_of(edges), nodes)
    left, done = cut(e), []
    alive = cut(all_nodes)
    while True:
        # nodes without an edge in or without one out are components of their own
        while True:
            inner = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
            kept = cut(alive.join(inner, "node", "left_semi"))
            alone, n_alone = counted(alive.join(kept, "node", "left_anti"))
            if not n_alone:
                break
            done.append(alone.select("node", F.col("node").alias("component")))
            alive = kept
            left = cut(within(left, alive))
        if alive.isEmpty():
            break
        colour = cut(alive.select("node", F.col("node").alias("c")))
        while True:
            sent = left.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("c").alias("m"))
            moved = F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("moved")
            new = cut(colour.join(sent, F.col("node") == F.col("dst"), "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), moved), moved=F.count_if("moved"))
            colour = new.select("node", "c")
            if not new.seen["moved"]:
                break
        shades = colour.withColumnsRenamed({"node": "n", "c": "k"})
        same = left.join(colour, F.col("src") == F.col("node")).drop("node").join(shades, (F.col("dst") == F.col("n")) & (F.col("c") == F.col("k"))).select("src", "dst", "c")
        same = cut(same)
        reached = cut(colour.where("node = c").select("node", "c"))
        frontier = reached
        while True:
            back = same.join(frontier.select(F.col("node").alias("n"), F.col("c").alias("k")), (F.col("dst") == F.col("n")) & (F.col("c") == F.col("k"))).select(F.col("src").alias("node"), "c").distinct()
            frontier, n_frontier = counted(back.join(reached, ["node", "c"], "left_anti"))
            if not n_frontier:
                break
            reached = cut(reached.unionAll(frontier))
        done.append(reached.select("node", F.col("c").alias("component")))
        alive = cut(alive.join(reached, "node", "left_anti"))
        left = cut(within(left, alive))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def within(e: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select(F.col("node").alias("n"))
    return e.join(n, F.col("src") == F.col("n"), "left_semi").join(n, F.col("dst") == F.col("n"), "left_semi")


def label_propagation(edges: DataFrame, undirected: bool = False, max_iter: int = 10) -> DataFrame:
    """label, node: all nodes at once take the label with most weight among neighbours, the smaller on ties."""
    e = cut(edges_of(edges, undirected))
    labels = cut(nodes_of(e).select("node", F.col("node").alias("label")))
    for _ in range(max_iter):
        votes = e.join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).getField("label").alias("best"))
        new = labels.join(best, F.col("node") == F.col("src"), "left").select("node", F.coalesce("best", "label").alias("label"), F.col("label").alias("old"))
        new = cut(new, moved=F.count_if(F.col("label") != F.col("old")))
        labels = new.select("node", "label")
        if not new.seen["moved"]:
            break
    return labels.select("label", "node")


def top_sort(edges: DataFrame) -> DataFrame:
    """idx, node: levels by peeling nodes without edges in; nodes on or behind cycles are left out."""
    e = cut(edges_of(edges).select("src", "dst"))
    alive, left, level, found = cut(nodes_of(e)), e, 0, []
    while True:
        free, n_free = counted(alive.join(left.select(F.col("dst").alias("node")), "node", "left_anti"))
        if not n_free:
            break
        found.append(free.select("node", F.lit(level).alias("level")))
        alive = cut(alive.join(free, "node", "left_anti"))
        left = cut(left.join(free.select(F.col("node").alias("n")), F.col("src") == F.col("n"), "left_anti"))
        level += 1
    out = None
    for f in found:
        out = f if out is None else out.unionAll(f)
    if out is None:
        return alive.select(F.lit(0).cast("long").alias("idx"), "node").limit(0)
    return numbered(cut(out), ["level"], ["node"], "idx").select("idx", "node")


def numbered(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Numbers rows from 0 by `groups` and `order`: ranges of the sort order are numbered apart, and shifted by the counts before them."""
    return numbered_as_is(df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order), out)


def numbered_as_is(df: DataFrame, out: str) -> DataFrame:
    """Numbers rows from 0 in the order in which they stand."""
    parts = cut(df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("first")).collect()  # a row for each partition
    at, shift = 0, []
    for r in sorted(sizes, key=lambda r: r["_p"]):
        shift.append((r["_p"], at - r["first"]))
        at += r["n"]
    shifts = df.sparkSession.createDataFrame(shift, "_q int, _shift long")
    return parts.join(F.broadcast(shifts), F.col("_p") == F.col("_q")).withColumn(out, F.col("_i") + F.col("_shift")).drop("_p", "_i", "_q", "_shift")


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """from, to, cost of a forest of least weight, by Borůvka's rounds: each component picks its cheapest edge out."""
    e = edges_of(edges, negative=True).where("src <> dst")
    e = cut(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.min("weight").alias("weight")))
    comp = cut(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("c")))
    chosen = e.limit(0)
    while True:
        ca, cb = comp.select(F.col("node").alias("na"), F.col("c").alias("ca")), comp.select(F.col("node").alias("nb"), F.col("c").alias("cb"))
        out, n_out = counted(e.join(ca, F.col("a") == F.col("na")).join(cb, F.col("b") == F.col("nb")).where("ca <> cb").select("a", "b", "weight", "ca", "cb"))
        if not n_out:
            break
        sides = out.select(F.col("ca").alias("c"), "a", "b", "weight").unionAll(out.select("cb", "a", "b", "weight"))
        best = sides.groupBy("c").agg(F.min(F.struct("weight", "a", "b")).alias("m")).select("m.a", "m.b", "m.weight").distinct()
        chosen = cut(chosen.unionByName(best.select("a", "b", "weight")).distinct())
        merged = connected_components(chosen.select("a", "b")).select(F.col("node").alias("n"), "component")
        comp = cut(comp.join(merged, F.col("node") == F.col("n"), "left").select("node", F.coalesce("component", "c").alias("c")))
    return chosen.select(F.col("a").alias("from"), F.col("b").alias("to"), F.col("weight").alias("cost"))


# --- paths ------------------------------------------------------------------------------------------------


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame | None = None, undirected: bool = False, keep_ties: bool = False) -> DataFrame:
    """start, end, cost, path. Each round relaxes the edges out of the nodes whose cost fell.

    Of equal paths the one whose text is least stays, or all with keep_ties and ends; ends that are
    not reached have infinite cost and an empty path.
    """
    e = cut(edges_of(edges, undirected).where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    s = one(starts, "start")
    best = cut(s.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.array("start").alias("path")))
    frontier = best
    while True:
        step = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        step = step.where(~F.array_contains(F.slice(F.col("path"), F.lit(1), F.size("path") - 1), F.col("node")))
        if keep_ties and ends is not None:
            step = step.distinct()
            merged = best.unionAll(step).distinct()
            least = merged.groupBy("start", "node").agg(F.min("cost").alias("m")).select(F.col("start").alias("s2"), F.col("node").alias("n2"), "m")
            merged = merged.join(least, (F.col("start") == F.col("s2")) & (F.col("node") == F.col("n2")) & (F.col("cost") == F.col("m"))).select("start", "node", "cost", "path")
        else:
            merged = best.unionAll(step).groupBy("start", "node").agg(F.min(F.struct("cost", "path")).alias("m")).select("start", "node", "m.cost", "m.path")
        merged = cut(merged)
        frontier, n_frontier = counted(merged.join(best, ["start", "node", "cost", "path"], "left_anti"))
        best = merged
        if not n_frontier:
            break
    out = best.select("start", F.col("node").alias("end"), "cost", "path")
    if ends is None:
        return out
    pairs = s.crossJoin(one(ends, "goal"))  # what is asked for: every start with every end
    out = pairs.join(out.withColumnRenamed("start", "s3"), (F.col("start") == F.col("s3")) & (F.col("goal") == F.col("end")), "left")
    return out.select("start", F.col("goal").alias("end"), F.coalesce("cost", F.lit(math.inf)).alias("cost"), F.coalesce("path", F.slice(F.array("start"), 1, 0)).alias("path"))


def shortest_path_bfs(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """start, end, path with fewest edges; null where there is none, or where start is end."""
    e = edges_of(edges).select("src", "dst")
    out = shortest_paths(e, starts, ends)
    none = (F.size("path") == 0) | F.col("start").eqNullSafe(F.col("end"))
    return out.select("start", "end", F.when(none, F.lit(None)).otherwise(F.col("path")).alias("path"))


def breadth_first(edges: DataFrame, nodes: DataFrame, starts: DataFrame, condition, limit: int = 1) -> DataFrame:
    """start, goal, path: the first `limit` nodes from each start, by distance and then path, that meet the condition."""
    e = cut(edges_of(edges).select("src", "dst").distinct())
    names = nodes.columns
    goals = cut(nodes.where(condition(nodes)).select(F.col(f"`{names[0]}`").alias("goal")).distinct())
    seen = cut(one(starts, "start").select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    frontier, found = seen, None
    while True:
        step = frontier.join(e, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier, n_frontier = counted(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if not n_frontier:
            break
        seen = cut(seen.unionAll(frontier))
        hits = cut(frontier.join(goals, F.col("node") == F.col("goal")).select("start", "goal", "path"))
        found = hits if found is None else cut(found.unionAll(hits))
        full = found.groupBy("start").count().where(F.col("count") >= limit).select("start")
        frontier = frontier.join(full, "start", "left_anti")
    if found is None:
        return seen.select("start", F.col("node").alias("goal"), "path").limit(0)
    from pyspark.sql.window import Window

    w = Window.partitionBy("start").orderBy(F.size("path"), "path")
    return found.withColumn("i", F.row_number().over(w)).where(F.col("i") <= limit).select("start", "goal", "path")


def distances(e: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, cost over edges_of(): as shortest_paths(), without the paths."""
    e = cut(e.where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    best = cut(one(starts, "start").select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fell")))
    while True:
        step = best.where("fell").join(e, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        both = best.select("start", "node", "cost").join(step, ["start", "node"], "full")
        fell = F.col("cost").isNull() | F.coalesce(F.col("new") < F.col("cost"), F.lit(False))
        new = cut(both.select("start", "node", F.when(fell, F.col("new")).otherwise(F.col("cost")).alias("cost"), fell.alias("fell")), fell=F.count_if("fell"))
        discard(best)
        best = new
        if not new.seen["fell"]:
            return best.select("start", "node", "cost")


def closeness_centrality(edges: DataFrame, undirected: bool = False) -> DataFrame:
    """node, c = reached^2 / sum of distances / (n - 1); reached counts the node itself."""
    e = edges_of(edges, undirected)
    nodes, n = counted(nodes_of(e))
    s = distances(e, nodes).groupBy("start").agg(F.count(F.lit(1)).alias("k"), F.sum("cost").alias("sum"))
    c = F.when((F.col("sum") > 0) & F.lit(n > 1), F.col("k") * F.col("k") / F.col("sum") / F.lit(float(max(n - 1, 1)))).otherwise(F.lit(0.0))
    return s.select(F.col("start").alias("node"), c.alias("c"))


# --- per source over a broadcast graph -------------------------------------------------------------------


class Graph:
    """Adjacency of a graph that fits in memory."""

    def __init__(self, rows) -> None:
        self.out = defaultdict(list)
        self.nodes = []
        seen = set()
        for a, b, w in rows:
            self.out[a].append((b, w))
            for x in (a, b):
                if x not in seen:
                    seen.add(x)
                    self.nodes.append(x)


def broadcast_graph(e: DataFrame):
    """The edges on every executor, sorted; refused beyond MOST_EDGES, and not counted further than that."""
    if e.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise EngineError("graph::size", f"this algorithm runs over at most {MOST_EDGES:,} edges")
    rows = sorted(tuple(r) for r in e.select("src", "dst", "weight").collect())
    return e.sparkSession.sparkContext.broadcast(rows)


def per_source(e: DataFrame, sources: DataFrame, run, schema: T.StructType) -> DataFrame:
    """run(graph, rows of sources) for each partition of sources."""
    shared = broadcast_graph(e)

    def over(batches):
        import pandas as pd

        graph = Graph(shared.value)
        for pdf in batches:
            out = [x for row in pdf.itertuples(index=False) for x in run(graph, *row)]
            yield pd.DataFrame(out, columns=schema.names)

    return sources.mapInPandas(over, schema)


def schema_of(e: DataFrame, *columns) -> T.StructType:
    node = e.schema["src"].dataType
    kinds = {"node": node, "path": T.ArrayType(node), "cost": T.DoubleType(), "long": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns])


def dijkstra(graph: Graph, start, goal=None, banned_nodes=frozenset(), banned_edges=frozenset(), heuristic=None):
    """(costs, predecessors) from start, stopping at goal."""
    cost, before, done = {start: 0.0}, {}, set()
    heap = [(heuristic(start) if heuristic else 0.0, 0, start)]
    tie = 0
    while heap:
        _, _, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        if x == goal:
            break
        for y, w in graph.out.get(x, ()):
            if y in banned_nodes or (x, y) in banned_edges:
                continue
            c = cost[x] + w
            if c < cost.get(y, math.inf):
                cost[y], before[y] = c, x
                tie += 1
                heapq.heappush(heap, (c + (heuristic(y) if heuristic else 0.0), tie, y))
    return cost, before


def traced(before: dict, start, goal) -> list:
    path = [goal]
    while path[-1] != start:
        path.append(before[path[-1]])
    return path[::-1]


def yen(graph: Graph, start, goal, k: int) -> list[tuple[float, list]]:
    weight = defaultdict(lambda: math.inf)
    for a, out in graph.out.items():
        for b, w in out:
            weight[a, b] = min(weight[a, b], w)
    cost, before = dijkstra(graph, start, goal)
    if goal not in cost:
        return []
    found = [(cost[goal], traced(before, start, goal))]
    offers: list = []
    while len(found) < k:
        _, last = found[-1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            banned = {(p[i], p[i + 1]) for _, p in found if len(p) > i + 1 and p[: i + 1] == root}
            cost, before = dijkstra(graph, root[-1], goal, set(root[:-1]), banned)
            if goal in cost:
                path = root[:-1] + traced(before, root[-1], goal)
                offer = (sum(weight[a, b] for a, b in zip(path, path[1:], strict=False)), path)
                if offer not in offers:
                    offers.append(offer)
        offers = [o for o in offers if o not in found]
        if not offers:
            break
        best = min(offers, key=lambda o: (o[0], [str(x) for x in o[1]]))
        offers.remove(best)
        found.append(best)
    return found


def k_shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, k: int, undirected: bool = False) -> DataFrame:
    e = edges_of(edges, undirected)
    pairs = one(starts, "a").crossJoin(one(ends, "b"))
    return per_source(e, pairs, lambda g, a, b: [(a, b, c, p) for c, p in yen(g, a, b, k)], schema_of(e, ("start", "node"), ("end", "node"), ("cost", "cost"), ("path", "path")))


def a_star(edges: DataFrame, starts: DataFrame, goals: DataFrame, estimates: DataFrame) -> DataFrame:
    """start, goal, cost, path; estimates(node, goal, h) holds the heuristic's values."""
    e = edges_of(edges)
    h = estimates.select("node", "goal", F.col("h").cast("double"))
    if h.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise EngineError("graph::size", "too many estimates")
    table = e.sparkSession.sparkContext.broadcast({(r[0], r[1]): r[2] for r in h.collect()})
    pairs = one(starts, "a").crossJoin(one(goals, "b"))

    def run(g, a, b):
        cost, before = dijkstra(g, a, b, heuristic=lambda x: table.value.get((x, b), 0.0))
        return [(a, b, cost[b], traced(before, a, b))] if b in cost else [(a, b, math.inf, [])]

    return per_source(e, pairs, run, schema_of(e, ("start", "node"), ("goal", "node"), ("cost", "cost"), ("path", "path")))


def depth_first(edges: DataFrame, nodes: DataFrame, starts: DataFrame, condition, limit: int = 1) -> DataFrame:
    """start, goal, path of the first `limit` nodes in depth-first order that meet the condition."""
    e = edges_of(edges)
    names = nodes.columns
    chosen = nodes.where(condition(nodes)).select(F.col(f"`{names[0]}`"))
    if chosen.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise EngineError("graph::size", "too many goals")
    goals = e.sparkSession.sparkContext.broadcast({r[0] for r in chosen.collect()})

    def run(g, start):
        seen, stack, before, found = set(), [(start, None)], {}, []
        while stack and len(found) < limit:
            x, parent = stack.pop()
            if x in seen:
                continue
            seen.add(x)
            if parent is not None:
                before[x] = parent
            if x != start and x in goals.value:
                found.append((start, x, traced(before, start, x)))
            stack += [(y, x) for y, _ in reversed(g.out.get(x, [])) if y not in seen]
        return found

    return per_source(e, one(starts, "a"), run, schema_of(e, ("start", "node"), ("goal", "node"), ("path", "path")))


def betweenness_centrality(edges: DataFrame, undirected: bool = False) -> DataFrame:
    """node, score: Brandes' accumulation from every source; scores of sources are added up by an aggregate."""
    e = edges_of(edges, undirected)

    def run(g, start):
        dist, count, parents, order, heap, tie = {start: 0.0}, defaultdict(float, {start: 1.0}), defaultdict(list), [], [(0.0, 0, start)], 0
        done = set()
        while heap:
            d, _, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            order.append(x)
            for y, w in g.out.get(x, ()):
                new = d + w
                if new < dist.get(y, math.inf) - 1e-12:
                    dist[y], count[y], parents[y] = new, count[x], [x]
                    tie += 1
                    heapq.heappush(heap, (new, tie, y))
                elif abs(new - dist[y]) <= 1e-12 and y not in done:
                    count[y] += count[x]
                    parents[y].append(x)
        share = defaultdict(float)
        for y in reversed(order):
            for x in parents[y]:
                share[x] += count[x] / count[y] * (1 + share[y])
        return [(y, share[y]) for y in order if y != start] + [(start, 0.0)]

    parts = per_source(e, nodes_of(e), run, schema_of(e, ("node", "node"), ("score", "cost")))
    return parts.groupBy("node").agg(F.sum("score").alias("score"))


def random_walk(edges: DataFrame, starts: DataFrame, steps: int, iterations: int = 1, seed: int = 0) -> DataFrame:
    """walk_id, start, path: a step of all walks at a time; an edge is drawn in proportion to its weight.

    The draw is the edge with the least -ln(u) / weight, u a hash of walk, step and edge: a partial
    aggregate, and the same walk on every run.
    """
    e = cut(edges_of(edges))
    walks = one(starts, "start").crossJoin(starts.sparkSession.range(iterations).select(F.col("id").alias("n")))
    walks = cut(numbered(walks, ["start"], ["n"], "walk_id").select("walk_id", "start", F.array("start").alias("path")))
    done = None
    for i in range(steps):
        u = (F.pmod(F.xxhash64("walk_id", F.lit(i), "dst", F.lit(seed)), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)
        step = walks.join(e, F.element_at("path", -1) == F.col("src")).where("weight > 0")
        step = step.groupBy("walk_id", "start", "path").agg(F.min(F.struct((-F.ln(u) / F.col("weight")).alias("k"), "dst")).getField("dst").alias("to"))
        step = cut(step)
        ended = walks.join(step.select("walk_id"), "walk_id", "left_anti")
        done = ended if done is None else done.unionAll(ended)
        walks = step.select("walk_id", "start", F.concat("path", F.array("to")).alias("path"))
    return walks if done is None else walks.unionAll(done)


def louvain(edges: DataFrame, undirected: bool = False, max_iter: int = 10, delta: float = 1e-4, keep_depth: int | None = None) -> DataFrame:
    """labels (coarse to fine), node: Louvain's moves in a fixed order, over a graph of bounded size."""
    e = edges_of(edges, undirected)
    rows = broadcast_graph(e).value
    node = e.schema["src"].dataType
    weight: dict = defaultdict(float)
    for a, b, w in rows:
        weight[a, b] += w / 2
        weight[b, a] += w / 2
    member = {x: x for ab in weight for x in ab}
    names = {x: i for i, x in enumerate(sorted(member, key=str))}
    graph = defaultdict(float)
    for (a, b), w in weight.items():
        graph[names[a], names[b]] += w
    level, levels = {x: names[x] for x in member}, []
    while True:
        moved, groups = one_level(graph, max_iter, delta)
        if not moved:
            break
        order = {c: i for i, c in enumerate(sorted(set(groups.values())))}
        level = {x: order[groups[c]] for x, c in level.items()}
        levels.append(level)
        coarse = defaultdict(float)
        for (a, b), w in graph.items():
            coarse[order[groups[a]], order[groups[b]]] += w
        graph = coarse
    kept = levels[::-1] or [level]
    kept = kept[:keep_depth] if keep_depth else kept
    schema = T.StructType([T.StructField("labels", T.ArrayType(T.LongType())), T.StructField("node", node)])
    return e.sparkSession.createDataFrame([([x[n] for x in kept], n) for n in member], schema)


def one_level(graph: dict, max_iter: int, delta: float) -> tuple[bool, dict]:
    near, degree = defaultdict(dict), defaultdict(float)
    for (a, b), w in graph.items():
        near[a][b] = w
        degree[a] += w
    total = sum(degree.values())
    group, mass = {x: x for x in degree}, dict(degree)
    moved = False
    for _ in range(max_iter):
        gain = 0.0
        for x in sorted(degree):
            mass[group[x]] -= degree[x]
            links = defaultdict(float)
            for y, w in near[x].items():
                if y != x:
                    links[group[y]] += w
            score = lambda c: links.get(c, 0.0) - mass[c] * degree[x] / total  # noqa: B023, E731
            best = max(sorted(set(links) | {group[x]}), key=lambda c: (score(c), c == group[x]))
            if score(best) > score(group[x]) + 1e-12:
                gain += 2 * (score(best) - score(group[x])) / total
                group[x], moved = best, True
            mass[group[x]] += degree[x]
        if gain < delta:
            break
    return moved, group


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes reached from the starts, with the distance in edges: (node, hops)."""
    e = cut(edges_of(edges).select("src", "dst").distinct())
    seen = cut(one(starts, "node").withColumn("hops", F.lit(0)))
    frontier, hops = seen, 0
    while True:
        hops += 1
        step = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier, n = counted(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hops)))
        if not n:
            return seen
        seen = seen.unionAll(frontier)  # files of one round each
