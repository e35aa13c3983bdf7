"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length one, where cosine >= t is distance <= sqrt(2 - 2t). Equal vectors of a
label become one class first. Classes are dealt into cells: the nearest of a label's pivots, as
many as its size asks for; a class also visits each other cell whose ball (covering radius plus
threshold) it may reach. Cells that still have too many residents are dealt again by pivots of their
own, and visitors with them, round by round. In each cell, a cover tree (nested levels, radii halving,
the covering radius of each node measured) holds the residents, others the visitors, some thousands
each, and a dual traversal compares node pairs, whole groups of children at a time. Pairs whose
centres are further apart than both covering radii and the threshold hold no link; pairs whose
centres and both radii are within the threshold hold nothing else, and are counted whole. What is
left at the leaves is compared itself.

Vectors spread evenly over many dimensions visit almost every cell, and no bound tells them apart: all
pairs of a label are compared then, as products of matrices. So few of them are shipped as cells are
large, visitors do not count for whether a cell is dealt again, a cell's many visitors meet its
residents in tasks of their own, and the small groups of a tree share leaves.

A cell returns, per class, how many vectors it links with, and a spanning forest of its links, not
the links: linear in its members, however close they are. Components are joined over all cells.
A cell whose members are all so close that pivots do not tell them apart stays one task, linear in
time, but with its distinct vectors in memory.

Null vectors or labels, zero vectors and vectors with null or non-finite components link with
nothing; vectors of different lengths do not link. Repeated rows are members of one class, and each
counts as another vector. A null id takes part; it is never a component's smallest id unless all
are null. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import components, materialise

SLACK = 1e-9  # cosines this close to the threshold are decided by one rule
BOUND = 1e-6  # bounds of balls are loosened by this much, so that rounding never prunes or counts a pair wrongly


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.98
    cell: int = 16384  # residents that a cell is meant to hold
    visitors: int = 65536  # that meet a cell's residents in one task
    most_pivots: int = 256  # of a cell at a time; larger cells are dealt again
    leaf: int = 32
    shared: int = 512  # points of a leaf that small groups share
    chunk: int = 4096  # rows that meet a cell's pivots in one task

    @property
    def reach(self) -> float:
        return math.sqrt(max(0.0, 2 - 2 * self.cosine))


# --- the tree ------------------------------------------------------------------------------------


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    children: list  # of Node; empty for a leaf
    points: np.ndarray  # all that stand below it
    joined: bool = False  # whether they are known to be of one component


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def net(x: np.ndarray, points: np.ndarray, radius: float) -> list[np.ndarray]:
    """Groups of points around centres (the first of each) that are more than radius apart."""
    left, groups, most = points, [], 1
    while len(left):
        # the next candidates at once, more of them where most turned out to be centres
        near = distances(x[left[:most]], x[left]) <= radius
        taken, centres = np.zeros(len(left), bool), 0
        for i in range(len(near)):
            if not taken[i]:
                own = near[i] & ~taken
                own[i] = True
                taken |= own
                groups.append(left[own])
                centres += 1
        left, most = left[~taken], min(256, 2 * centres)
    return groups


def build(x: np.ndarray, points: np.ndarray, radius: float, leaf: int, shared: int = 512) -> Node:
    """A node over points within `radius` of the first one, its children nested at half the radius."""
    centre = x[points[0]]
    covering = float(distances(centre[None], x[points])[0].max())
    if len(points) <= leaf or covering <= BOUND:
        return Node(centre, covering, [], points)
    half = radius / 2
    while half > covering:
        half /= 2
    groups = net(x, points, half) if half > BOUND else [points]
    if len(groups) == 1:
        return Node(centre, covering, [], points)
    # small groups need no level of their own, and as nodes would meet each other one by one: they wait in shared leaves
    children = [build(x, g, half, leaf, shared) for g in groups if len(g) > leaf]
    few = np.concatenate([np.empty(0, np.int64), *[g for g in groups if len(g) <= leaf]])
    for i in range(0, len(few), shared):
        part = few[i : i + shared]
        children.append(Node(x[part[0]], float(distances(x[part[:1]], x[part])[0].max()), [], part))
    return Node(centre, covering, children, points)


def dual(a: Node, b: Node, reach: float, leaf_pair, whole=None) -> None:
    """Call leaf_pair(points, points) for each pair of leaves that may hold links, and whole(node, node) for each pair of
    nodes that hold nothing but links. A node with itself stands for the pairs inside it; each pair comes up once."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a is b:
            if whole and 2 * a.radius + BOUND <= reach:
                whole(a, a)
            elif not a.children:
                leaf_pair(a.points, a.points)
            else:
                stack += [(c, c) for c in a.children]
                pairs(a.children, a.children, reach, stack, whole, True)
        elif not a.children and not b.children:
            leaf_pair(a.points, b.points)
        else:
            pairs(a.children or [a], b.children or [b], reach, stack, whole, False)


def pairs(left: list, right: list, reach: float, stack: list, whole, same: bool) -> None:
    """Push the pairs of nodes that need a closer look; hand over those within reach as a whole."""
    centres = distances(np.array([n.centre for n in left]), np.array([n.centre for n in right]))
    radii = np.add.outer([n.radius for n in left], [n.radius for n in right])
    near = centres <= radii + reach + BOUND
    if same:
        near = np.triu(near, 1)
    inside = near & (centres + radii + BOUND <= reach) if whole else np.zeros_like(near)
    for i, j in zip(*np.nonzero(inside), strict=True):
        whole(left[i], right[j])
    stack += [(left[i], right[j]) for i, j in zip(*np.nonzero(near & ~inside), strict=True)]


class Forest:
    """Union-find that keeps the links that joined something."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def link_cell(x: np.ndarray, sizes: np.ndarray, home: np.ndarray, s: Settings, among: bool = True) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For the members of a cell: how many vectors each links with here, and the links of a spanning forest.

    A resident meets residents (unless not `among`: another task of the cell does that) and visitors here;
    visitors do not meet each other (one of their cells is at home to either).
    """
    n = len(x)
    counts, forest, edges = np.zeros(n, np.int64), Forest(n), []
    residents, visitors = np.flatnonzero(home), np.flatnonzero(~home)

    def compare(p: np.ndarray, q: np.ndarray, same: bool) -> None:
        for at in range(0, len(p), 1024):
            part = p[at : at + 1024]
            close = x[part] @ x[q].T
            found = close >= s.cosine - SLACK
            if not found.any():
                continue
            i, j = np.nonzero(found)
            near = np.abs(close[i, j] - s.cosine) <= SLACK
            i, j = part[i], q[j]
            if near.any():  # products of different shapes round differently: decide by one rule
                exact = np.einsum("ij,ij->i", x[i[near]], x[j[near]])
                fine = np.ones(len(i), bool)
                fine[near] = exact >= s.cosine
                i, j = i[fine], j[fine]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            np.add.at(counts, i, sizes[j])
            np.add.at(counts, j, sizes[i])
            for u, v in zip(i.tolist(), j.tolist(), strict=True):
                if forest.join(u, v):
                    edges.append((u, v))

    def united(node: Node) -> int:
        first = int(node.points[0])
        if not node.joined:
            node.joined = True
            for p in node.points[1:].tolist():
                if forest.join(first, p):
                    edges.append((first, p))
        return first

    def whole(a: Node, b: Node) -> None:
        if a is b:
            counts[a.points] += sizes[a.points].sum() - sizes[a.points]
            united(a)
            return
        counts[a.points] += sizes[b.points].sum()
        counts[b.points] += sizes[a.points].sum()
        # points of one node need not link with each other, but all do with any one of the other
        u, v = int(a.points[0]), int(b.points[0])
        for p in ([] if a.joined else a.points.tolist()):
            if forest.join(v, p):
                edges.append((v, p))
        for p in ([] if b.joined else b.points.tolist()):
            if forest.join(u, p):
                edges.append((u, p))
        a.joined = b.joined = True
        if forest.join(u, v):
            edges.append((u, v))

    if len(residents):
        tree = build(x, residents, 2.0, s.leaf, s.shared)
        if among:
            dual(tree, tree, s.reach, lambda p, q: compare(p, q, p is q), whole)
        # the making of a tree of scattered points takes as long as comparing them all: several smaller ones
        for at in range(0, len(visitors), s.chunk):
            dual(tree, build(x, visitors[at : at + s.chunk], 2.0, s.leaf, s.shared), s.reach, lambda p, q: compare(p, q, False), whole)
    return counts, edges


# --- the operator ----------------------------------------------------------------------------------


def unit(v) -> np.ndarray | None:
    """The vector in double precision at length one; None if it can't link."""
    if v is None:
        return None
    x = np.array([np.nan if e is None else e for e in v], float)
    if not len(x) or not np.isfinite(x).all():
        return None
    biggest = np.abs(x).max()
    if not biggest > 0:
        return None
    x = x / biggest
    return x / math.sqrt(float(x @ x))


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, digest (of label and direction; null: links with nothing), unit (doubles)."""
    kind, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches):
        for batch in batches:
            nodes, units = [], []
            for v, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
                x = unit(v) if label is not None else None
                nodes.append(None if x is None else xxhash.xxh3_128_digest(repr(label).encode() + b"|" + x.tobytes()))
                units.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(nodes, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "label", "digest", "unit"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kind}, label {label}, digest binary, unit binary")


def matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), float).reshape(len(blobs), -1)


def near_pivots(members: DataFrame, few: DataFrame, schema: str, run) -> DataFrame:
    """run(rows, vectors of the pivots, radii or None) over members and the row of `few` for their cell (pivots, chunks[, radii]).

    A cell's rows are dealt into chunks, and its pivots sent to each chunk, so that a large cell is no task's alone.
    """
    cell = ["label", "dim", "cell"]
    deal = few.select(*[F.col(c).alias(f"_{c}") for c in cell], "chunks")
    on = F.col("label") == F.col("_label")
    for c in cell[1:]:
        on = on & (F.col(c) == F.col(f"_{c}"))
    rows = members.join(deal, on).drop(*[f"_{c}" for c in cell]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).drop("chunks")
    sent = few.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")

    def over(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.drop(["chunk"]).append_column("far", pa.array([], pa.float64()))
        given = right.to_pylist()[0]
        return run(left.drop(["chunk"]), matrix(given["pivots"]), given.get("radii"))

    return rows.groupBy(*cell, "chunk").cogroup(sent.groupBy(*cell, "chunk")).applyInArrow(over, schema)


def cells(classes: DataFrame, s: Settings) -> DataFrame:
    """Each class at home in one cell of its (label, dimension), and a visitor where it may link.

    A round deals all members of cells with too many residents: residents go to the nearest pivot, then residents
    and visitors visit where they may reach. Of two new cells that two residents come from, the one with the
    smaller number is the host. Cells that a round hardly made smaller are left as they are.
    """
    cell = ["label", "dim", "cell"]
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    members = classes.select("node", "label", "dim", F.lit("").alias("cell"), F.lit(True).alias("home"), "size", "unit", F.lit(None).cast("long").alias("above"))
    schema = f"node {kinds['node']}, label {kinds['label']}, dim int, cell string, home boolean, size long, unit binary, above long, far double"
    done = None
    while True:
        members = materialise(members, "cover_members")
        counts = members.groupBy(*cell).agg(F.count(F.lit(1)).alias("all"), F.count_if("home").alias("own"), F.min(F.when(F.col("home"), F.col("node"))).alias("least"), F.first("above").alias("above"))
        large = (F.col("own") > 2 * s.cell) & (F.col("own") > 1) & (F.col("above").isNull() | (F.col("own") < 0.8 * F.col("above")))
        counts = materialise(counts.withColumn("large", large), "cover_counts", n=F.count_if(large))
        if not counts.seen["n"]:
            return (members if done is None else done.unionByName(members)).drop("above")
        over = counts.where("large").withColumn("want", F.least(F.lit(s.most_pivots), F.greatest(F.lit(2), F.ceil(F.col("own") / F.lit(s.cell)))))
        named = over.select(*[F.col(c).alias(f"_{c}") for c in cell], "all", "own", "want", "least")
        on = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell"))
        left = members.join(named.select("_label", "_dim", "_cell"), on, "left_anti")
        done = left if done is None else done.unionByName(left)
        # a hash threshold keeps about twice the pivots wanted, and the smallest class stands for a cell where none passes
        passes = F.pmod(F.xxhash64("node", "cell"), F.lit(1 << 20)) <= F.lit(float(1 << 20)) * (2 * F.col("want") + 8) / F.col("own")
        few = members.where("home").join(named, on).where(passes | (F.col("node") == F.col("least")))
        few = few.groupBy(*cell, "want", "all", "own").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        few = few.select(*cell, F.slice("units", F.lit(1), F.col("want").cast("int")).alias("pivots"), F.ceil(F.col("all") / F.lit(s.chunk)).alias("chunks"), "own")
        few = materialise(few, "cover_pivots")
        large_ones = members.join(named.select("_label", "_dim", "_cell"), on, "left_semi")

        def place(rows: pa.Table, pivots: np.ndarray, _) -> pa.Table:
            d = distances(matrix(rows.column("unit").to_pylist()), pivots)
            return rows.append_column("far", pa.array(d.min(axis=1))).set_column(rows.schema.get_field_index("above"), "above", pa.array(d.argmin(axis=1).astype(np.int64)))

        # for residents, `above` holds the number of the nearest pivot until the new cells have names
        placed = materialise(near_pivots(large_ones.where("home"), few.drop("own"), schema, place), "cover_home")
        radii = placed.groupBy(*cell, "above").agg(F.max("far").alias("radius")).groupBy(*cell).agg(F.collect_list(F.struct("above", "radius")).alias("radii"))
        both = materialise(few.join(radii, cell), "cover_radii")

        def visit(rows: pa.Table, pivots: np.ndarray, given, reach=s.reach) -> pa.Table:
            radius = np.full(len(pivots), -np.inf)
            for r in given:
                radius[r["above"]] = r["radius"]
            d = distances(matrix(rows.column("unit").to_pylist()), pivots)
            nearest = d.argmin(axis=1)
            # within reach of the ball, and of the border with the nearest cell
            may = (d <= radius + reach + BOUND) & (d - d.min(axis=1)[:, None] <= 2 * reach + BOUND)
            home = np.array(rows.column("home").to_pylist(), bool)
            may &= ~home[:, None] | (np.arange(len(pivots)) < nearest[:, None])
            i, j = np.nonzero(may)
            own = np.flatnonzero(home)
            at, to = np.concatenate([own, i]), np.concatenate([nearest[own], j])
            out = rows.take(pa.array(at))
            names = pa.array([f"{c}.{t}" for c, t in zip(out.column("cell").to_pylist(), to.tolist(), strict=True)], pa.string())
            out = out.set_column(out.schema.get_field_index("cell"), "cell", names)
            out = out.set_column(out.schema.get_field_index("home"), "home", pa.array(np.arange(len(at)) < len(own)))
            return out.append_column("far", pa.array(np.zeros(len(at))))

        dealt = near_pivots(large_ones, both.drop("own"), schema, visit).drop("above", "far")
        # the residents of the cell that a new cell comes from
        parents = few.select("label", "dim", F.col("cell").alias("_parent"), F.col("own").alias("above"))
        dealt = dealt.withColumn("_parent", F.regexp_replace("cell", r"\.[0-9]+$", "")).join(parents, ["label", "dim", "_parent"]).drop("_parent")
        members = dealt.select("node", "label", "dim", "cell", "home", "size", "unit", "above")


def parted(members: DataFrame, s: Settings) -> DataFrame:
    """members with `part`: the task of their cell. A cell with many visitors has several; its residents come to each."""
    cell = ["label", "dim", "cell"]
    wide = members.groupBy(*cell).agg(F.ceil(F.count_if(~F.col("home")) / F.lit(s.visitors)).alias("parts")).where("parts > 1").select(*[F.col(c).alias(f"_{c}") for c in cell], "parts")
    on = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell"))
    rows = members.join(wide, on, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    part = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts"))))
    return rows.select(*members.columns, F.explode(part).alias("part"))


def near_duplicates(vectors: DataFrame, settings: Settings | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, label, embedding)."""
    s = settings or Settings()
    rows = materialise(prepared(vectors), "cover_rows")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("unit").alias("unit"), F.min("vec_id").alias("least"))
    classes = materialise(classes.withColumn("dim", (F.octet_length("unit") / 8).cast("int")).withColumn("node", F.monotonically_increasing_id()), "cover_classes")

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        x = matrix(table.column("unit").to_pylist())
        counts, edges = link_cell(x, table.column("size").to_numpy().astype(np.int64), np.array(table.column("home").to_pylist(), bool), s, among=table.column("part")[0].as_py() == 0)
        linked = np.flatnonzero(counts).tolist()
        rows = [(nodes[i], None, int(counts[i])) for i in linked] + [(nodes[i], nodes[j], 0) for i, j in edges]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

    found = parted(cells(classes, s), s).groupBy("label", "dim", "cell", "part").applyInArrow(run, "a long, b long, links long")
    found = materialise(found, "cover_links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    known = classes.select("node", "digest", "size", "least").join(links, F.col("node") == F.col("a"), "left").drop("a")
    known = known.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("digest", "size", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    smallest = known.groupBy("root").agg(F.min("least").alias("id")).withColumnRenamed("root", "_root")
    known = known.join(smallest, F.col("root") == F.col("_root")).select(F.col("digest").alias("_digest"), "size", "links", "id")
    out = rows.select("vec_id", "digest").join(known, F.col("digest") == F.col("_digest"), "left")
    alone = F.col("digest").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("id"))
    return out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("size") - 1 + F.col("links")).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
