"""Components, strong components and closures of many graphs at once, keyed by graph_id.

Every loop writes its rounds to the folder named in ``spark.checkpoint.dir`` and deletes those that no later round reads.

Edge cases: rows with a null end are left out, self loops keep their node and nothing else, repeated edges count once, no edges give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, ship

#: Shares of a node's neighbours.
SALTS = 32
#: Edges of a graph that one task may hold.
MOST_EDGES = 200_000
#: The share of edges that a step which takes off ends may leave for another one to follow.
LEFT = 0.7
#: Rows of a batch that gathers small graphs.
BATCH = 10_000
#: Nodes along a side of a tile of bits.
TILE = 512
#: Bytes of bits that a task works on at a time.
HELD = 64 << 20
#: Tiles of a batch.
KEPT = 200
c, g = F.col, "graph_id"


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _edges(edges: DataFrame) -> DataFrame:
    return edges.filter("a is not null and b is not null").select(g, "a", "b").distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """(graph_id, u, v, m) of every edge (u, v), with the smallest neighbour ``m`` of u: a minimum of minima of shares."""
    edges = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    share = edges.groupBy(g, "u", "s").agg(F.min("v").alias("m"))
    return edges.join(share.withColumn("m", F.min("m").over(Window.partitionBy(g, "u"))), [g, "u", "s"]).select(g, "u", "v", "m")


def _forest(a: list[int], b: list[int], n: int) -> list[int]:
    """The smallest node of each node's component; nodes are 0..n-1."""
    up = list(range(n))
    for x, y in zip(a, b, strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x < y:
            up[y] = x
        else:
            up[x] = y
    for x in range(n):  # a node's parent is smaller, and so is settled
        up[x] = up[up[x]]
    return up


def components(edges: DataFrame, most_rounds: int = 60, most_edges: int = MOST_EDGES) -> DataFrame:
    """(graph_id, node, root): every node with the smallest node it is connected to, whatever the direction.

    Graphs of at most ``most_edges`` edges are solved in a task each. Larger ones lose their leaves first, which follow their
    only neighbour later, while that gains; what is then still too large goes in rounds of large and small stars: a node's larger
    neighbours move to its smallest one, so a hub costs rows in proportion to its edges and rounds grow with the logarithm of a component's size.
    """
    first = materialize(_edges(edges).select(g, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now, solved, hung, held = first, [], [], [first]
    gains = True
    while True:
        n = now.groupBy(g).agg(F.count("*").alias("n"))
        large = materialize(n.filter(c("n") > most_edges).select(g))
        solved.append(_whole(now.join(large, g, "left_anti").select(g, c("u").alias("a"), c("v").alias("b")), lambda n, a, b: np.array(_forest(a.tolist(), b.tolist(), n))))
        if large.isEmpty():
            break
        rest = materialize(now.join(large, g, "left_semi"))
        if not gains:
            solved.append(_starred(rest, most_rounds))
            break
        leaf = materialize(_leaves(rest))
        core = rest
        for side in ("u", "v"):
            core = core.join(leaf.select(g, c("x").alias(side)), [g, side], "left_anti")
        now = materialize(core)
        gains = now.count() <= LEFT * rest.count()
        hung.append(leaf)
        held += [rest, now]
    if not hung:
        return solved[0]
    label = materialize(_union(*solved))
    for leaf in reversed(hung):
        at = leaf.join(label.select(g, c("node").alias("y"), "root"), [g, "y"], "left").select(g, "x", "y", F.coalesce("root", "y").alias("root"), c("root").isNull().alias("bare"))
        own = at.filter("bare").select(g, c("y").alias("node"), c("y").alias("root")).distinct()  # all its edges led to leaves
        before, label = label, materialize(_union(label, at.select(g, c("x").alias("node"), "root"), own))
        discard(before)
    least = label.groupBy(g, "root").agg(F.min("node").alias("least"))
    out = materialize(label.join(least, [g, "root"]).select(g, "node", c("least").alias("root")))
    discard(label, *hung, *held)
    return out


def _leaves(edges: DataFrame) -> DataFrame:
    """(graph_id, x, y) of nodes x with one neighbour y only; of two that have each other, the larger. Edges (graph_id, u, v) are distinct, u at least v."""
    true = edges.filter("u <> v")
    ends = _union(true.select(g, c("u").alias("x"), c("v").alias("y")), true.select(g, c("v").alias("x"), c("u").alias("y")), edges.filter("u = v").select(g, c("u").alias("x"), c("v").alias("y")))
    leaf = ends.groupBy(g, "x").agg(F.count("*").alias("n"), F.min("y").alias("y")).filter("n = 1 and x <> y").select(g, "x", "y")
    smaller = leaf.filter("x < y").select(g, "x", "y").join(leaf.select(g, c("x").alias("y"), c("y").alias("x")), [g, "x", "y"], "left_semi")
    return leaf.join(smaller, [g, "x", "y"], "left_anti")


def _starred(first: DataFrame, most_rounds: int) -> DataFrame:
    """``components`` of distinct edges (graph_id, u, v), u at least v, by rounds of stars."""
    now = first
    for _ in range(most_rounds):
        ends = now.filter("u <> v").select(g, F.explode(F.array(F.struct(c("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(c("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e")).select(g, "e.*")
        if ends.groupBy(g, "x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or (up > 0 and root > 0)").isEmpty():
            break
        true = now.filter("u <> v")
        both = true.select(g, "u", "v").union(true.select(g, c("v").alias("u"), c("u").alias("v")))
        large = _with_least(both).filter("v > u").select(g, c("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        small = _with_least(large).select(g, F.explode(F.array(F.struct(c("v").alias("u"), c("m").alias("v")), F.struct(c("u").alias("u"), c("m").alias("v")))).alias("e")).select(g, "e.u", "e.v").filter("u <> v")
        before, now = now, materialize(small.distinct())
        if before is not first:
            discard(before)
    else:
        raise RuntimeError("components did not settle")
    now = now.filter("u <> v")
    roots = now.select(g, c("u").alias("node"), c("v").alias("root"))
    own = now.select(g, c("v").alias("node"), c("v").alias("root")).distinct()
    alone = first.filter("u = v").select(g, c("u").alias("node"), c("u").alias("root"))
    return roots.union(own).union(alone.join(now.select(g, c("u").alias("node")), [g, "node"], "left_anti")).distinct()


def transitive_closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(graph_id, a, b) of everything a reaches. Semi-naive: only pairs of the last round are joined with all, on both sides.

    Path lengths double, so rounds grow with the logarithm of the longest path; a round's pairs are written once.
    """
    new = materialize(_edges(edges))
    parts = [new]
    for _ in range(most_rounds):
        every = _union(*parts)
        on = lambda l, r: l.alias("l").join(r.alias("r"), (c(f"l.{g}") == c(f"r.{g}")) & (c("l.b") == c("r.a"))).select(f"l.{g}", "l.a", "r.b")  # noqa: E741, E731
        new = materialize(on(new, every).union(on(every, new)).distinct().join(every, [g, "a", "b"], "left_anti"))
        if new.isEmpty():
            discard(new)
            return every
        parts.append(new)
    raise RuntimeError("the closure did not settle")


def _tarjan(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's strong component; nodes are 0..n-1."""
    order = np.argsort(a, kind="stable")
    to, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    seen, low, root, at = [-1] * n, [0] * n, [-1] * n, first[:-1]
    held: list[int] = []
    count = 0
    for start in range(n):
        if seen[start] >= 0:
            continue
        path = [start]
        seen[start] = low[start] = count
        count += 1
        held.append(start)
        while path:
            x = path[-1]
            if at[x] < first[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if seen[y] < 0:
                    seen[y] = low[y] = count
                    count += 1
                    held.append(y)
                    path.append(y)
                elif root[y] < 0:
                    low[x] = min(low[x], seen[y])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
            if low[x] == seen[x]:
                k = held.index(x) if len(held) < 64 else len(held) - 1 - held[::-1].index(x)
                own = held[k:]
                del held[k:]
                least = min(own)
                for y in own:
                    root[y] = least
    return np.array(root, np.int64)


def _whole(edges: DataFrame, solve: Callable[[int, np.ndarray, np.ndarray], np.ndarray] = _tarjan) -> DataFrame:
    """(graph_id, node, root) of graphs that a task may hold: ``solve`` gives each node's root from their number and edges."""
    ship(edges.sparkSession)

    deal = edges.sparkSession.sparkContext.defaultParallelism  # few large graphs are few bytes, which adaptive execution would give to one task

    def solved(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
        if len(a) == 1 and a != b:  # an edge alone
            x, y = a[0], b[0]
            return ([x, y], solve(2, np.array([0]), np.array([1]))) if x < y else ([y, x], solve(2, np.array([1]), np.array([0])))
        names, at = np.unique(np.array(a + b, dtype=object), return_inverse=True)
        return names.tolist(), solve(len(names), at[: len(a)], at[len(a) :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, b = None, [], []
        keys, nodes, roots = [], [], []

        def settle() -> None:
            names, root = solved(a, b)
            keys.extend([now] * len(names))
            nodes.extend(names)
            roots.extend(names[k] for k in root.tolist())

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (keys, nodes, roots)], names=[g, "node", "root"])
            for x in (keys, nodes, roots):
                x.clear()
            return rows

        for batch in batches:
            for k, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != now and a:
                    settle()
                    a, b = [], []
                    if len(keys) >= BATCH:
                        yield out()
                now = k
                a.append(x)
                b.append(y)
        if a:
            settle()
        if keys:
            yield out()

    return edges.select(g, "a", "b").repartition(deal, g).sortWithinPartitions(g).mapInArrow(run, f"{g} string, node string, root string")


def _contracted(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step: (edges after it, what was settled, what waits) for graphs too large for a task.

    A node without an edge in, or without one out, is a component of its own. A node with one edge out (in every other step: one
    in) is drawn into the node at its end, unless that one is drawn itself: whether it belongs to that one's component is
    known later, if another neighbour of it does. Which nodes are drawn is a coin a node and step, so a path loses a quarter.
    """
    forward = k % 2 == 0
    a, b = ("a", "b") if forward else ("b", "a")
    degree = _union(edges.select(g, c("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in"), c("b").alias("y")), edges.select(g, c("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in"), c("a").alias("y")))
    only = F.min(F.when(c("out") == (1 if forward else 0), c("y")))
    node = degree.groupBy(g, "x").agg(F.sum("out").alias("out"), F.sum("in").alias("in"), only.alias("w"))
    coin = F.pmod(F.xxhash64("x", F.lit(k)), F.lit(2)) == 0
    node = materialize(node.select(g, "x", ((c("out") == 0) | (c("in") == 0)).alias("ends"), "w", ((c("out") == 1 if forward else c("in") == 1) & coin).alias("drawn")))
    drawn = node.filter("drawn and not ends").select(g, "x", "w").join(node.filter("drawn and not ends").select(g, c("x").alias("w")), [g, "w"], "left_anti")
    drawn = drawn.join(node.filter("ends").select(g, c("x").alias("w")), [g, "w"], "left_anti")
    settled = node.filter("ends").select(g, c("x").alias("node"))
    live = edges
    for side in ("a", "b"):
        live = live.join(node.filter("ends").select(g, c("x").alias(side)), [g, side], "left_anti")
    into = live.join(drawn.withColumnRenamed("x", b), [g, b])  # edges to drawn nodes, each from a neighbour on the other side
    waiting = into.select(g, c(b).alias("x"), "w", c(a).alias("u"))
    moved = into.select(g, c(a).alias(a), c("w").alias(b)).filter("a <> b")
    kept = live.join(drawn.select(g, c("x").alias("a")), [g, "a"], "left_anti").join(drawn.select(g, c("x").alias("b")), [g, "b"], "left_anti")
    gone = drawn.select(g, "x", "w").withColumn("u", F.lit(None).cast("string"))
    return _union(kept.select(g, "a", "b"), moved.select(g, "a", "b")).distinct(), settled, _union(waiting, gone)


def _coloured(edges: DataFrame, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(edges between nodes not settled, settled (graph_id, node, root)): forward colours, then backward within a colour.

    Each node takes the smallest node that reaches it as its colour; what reaches that node within the colour is its component.
    """
    nodes = _union(edges.select(g, c("a").alias("x")), edges.select(g, c("b").alias("x"))).distinct()
    colour = materialize(nodes.withColumn("k", c("x")))
    for _ in range(most_rounds):
        near = edges.join(colour.withColumnRenamed("x", "a"), [g, "a"]).select(g, c("b").alias("x"), "k")
        after = materialize(_union(colour, near).groupBy(g, "x").agg(F.min("k").alias("k")))
        same = after.join(colour, [g, "x", "k"], "left_anti").isEmpty()
        discard(colour)
        colour = after
        if same:
            break
    side = lambda s: colour.select(g, c("x").alias(s), c("k").alias("k" + s))
    inner = materialize(edges.join(side("a"), [g, "a"]).join(side("b"), [g, "b"]).filter("ka = kb").select(g, "a", "b", c("ka").alias("k")))
    front = materialize(colour.filter("x = k"))
    parts = [front]
    for _ in range(most_rounds):
        found = _union(*parts)
        front = materialize(inner.join(front.select(g, c("x").alias("b"), "k"), [g, "b", "k"]).select(g, c("a").alias("x"), "k").distinct().join(found, [g, "x", "k"], "left_anti"))
        if front.isEmpty():
            break
        parts.append(front)
    found = materialize(_union(*parts))
    discard(inner, *parts)
    rest = edges
    for s in ("a", "b"):
        rest = rest.join(found.select(g, c("x").alias(s)), [g, s], "left_anti")
    return rest, found.select(g, c("x").alias("node"), c("k").alias("root"))


def strong_components(edges: DataFrame, most_edges: int = MOST_EDGES, most_rounds: int = 200) -> DataFrame:
    """(graph_id, node, root): nodes that reach each other, named by the smallest.

    Graphs of at most ``most_edges`` edges are solved in a task each. Larger ones shrink first: ends are trimmed while that gains,
    then paths are contracted too (``_contracted``), else components are taken out by colours; as soon as a graph fits a
    task it goes there. Rows are linear in edges; rounds grow with the logarithm of the longest path.
    """
    every = materialize(_edges(edges))
    nodes = _union(every.select(g, c("a").alias("node")), every.select(g, c("b").alias("node"))).distinct()
    now = every.filter("a <> b")
    solved: list[DataFrame] = []
    waits: list[DataFrame] = []
    held: list[DataFrame] = []
    last, k, gains = None, -1, True
    for _ in range(most_rounds):
        size = now.groupBy(g).agg(F.count("*").alias("n"))
        small = materialize(size.filter(c("n") <= most_edges).select(g))
        solved.append(materialize(_whole(now.join(small, g, "left_semi"))))
        now = materialize(now.join(small, g, "left_anti"))
        held.append(now)
        n = now.count()
        if not n:
            break
        if gains:  # what has no edge in, or none out, is a component of its own
            now = materialize(now.join(now.select(g, c("b").alias("a")), [g, "a"], "left_semi").join(now.select(g, c("a").alias("b")), [g, "b"], "left_semi"))
            held.append(now)
            gains = now.count() <= LEFT * n
            continue
        k += 1
        if last is not None and k % 2 == 0 and n > 0.9 * last:  # two steps gained little
            rest, settled = _coloured(now)
            solved.append(settled)
            now, last = materialize(rest), None
            held.append(now)
            continue
        if k % 2 == 0:
            last = n
        after, settled, waiting = _contracted(now, k)
        waits.append(materialize(waiting))
        solved.append(materialize(settled.withColumn("root", c("node"))))
        now = after
    else:
        raise RuntimeError("strong components did not settle")
    label = materialize(_union(*solved).distinct()) if waits else _union(*solved)
    for waiting in reversed(waits):
        of = lambda key: label.select(g, c("node").alias(key), c("root").alias("r" + key))  # noqa: B023, E731
        x = waiting.join(of("w"), [g, "w"], "left").join(of("u"), [g, "u"], "left").select(g, "x", F.coalesce("rw", "w").alias("rw"), F.when(c("u").isNotNull(), F.coalesce("ru", "u")).alias("ru"))
        late = x.groupBy(g, "x").agg(F.max("rw").alias("rw"), F.max(F.coalesce(c("rw") == c("ru"), F.lit(False))).alias("same"))
        before, label = label, materialize(_union(label, late.select(g, c("x").alias("node"), F.when(c("same"), c("rw")).otherwise(c("x")).alias("root"))))
        discard(before)
    out = materialize(nodes.join(label, [g, "node"], "left").select(g, "node", F.coalesce("root", "node").alias("root")))  # what lost its last edge is its own
    if waits:  # a path was drawn into its end, which need not be the smallest
        least = out.groupBy(g, "root").agg(F.min("node").alias("least"))
        named, out = out, materialize(out.join(least, [g, "root"]).select(g, "node", c("least").alias("root")))
        discard(named)
    discard(every, *held, *waits, *solved)
    return out


def numbered(nodes: DataFrame) -> DataFrame:
    """(graph_id, node, id, n): nodes numbered from 0 in order within their graph, which one task sorts, with their number."""
    w = Window.partitionBy(g)
    return nodes.select(g, "node", (F.row_number().over(w.orderBy("node")) - 1).alias("id"), F.count("*").over(w).cast("int").alias("n"))


def _side(n: int, i: int, tile: int) -> int:
    return min(tile, n - i * tile)


def unpacked(bits: bytes, n: int, i: int, j: int, tile: int = TILE) -> np.ndarray:
    """A tile as a matrix of 0 and 1."""
    rows, cols = _side(n, i, tile), _side(n, j, tile)
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=rows * cols).reshape(rows, cols)


_TILES = f"{g} string, n int, i int, j int, bits binary"


def _lists(first: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths) of the lists of ``x`` one after the other, list y lying at first[y] to first[y + 1]."""
    many = first[x + 1] - first[x]
    return np.repeat(first[x] - (np.cumsum(many) - many), many) + np.arange(many.sum()), many


class _Matrix:
    """What the nodes 0..n-1 of one graph reach, some columns at a time.

    Nodes that reach each other are one; each is worked on after those that it leads to, all of a level at once.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        self.n, self.cyclic = n, np.zeros(n, bool)
        self.cyclic[a[a == b]] = True
        a, b = a[a != b], b[a != b]
        self.root = np.arange(n)
        if not self._order(a, b):
            self.root = _tarjan(n, a, b)
            self.cyclic |= np.bincount(self.root, minlength=n)[self.root] > 1
            a, b = self.root[a], self.root[b]
            self._order(a[a != b], b[a != b])

    def _order(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Set the lists of neighbours and each node's level, the longest way down from it; False if a cycle leaves nodes without one."""
        by = lambda x, y: (y[np.argsort(x, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(x, minlength=self.n))]))
        self.below, self.at_below = by(a, b)
        self.above, self.at_above = by(b, a)
        self.level = np.full(self.n, -1)
        open_ = np.diff(self.at_below)
        front, k = np.flatnonzero(open_ == 0), 0
        while len(front):
            self.level[front] = k
            up, many = np.unique(self.above[_lists(self.at_above, front)[0]], return_counts=True)
            open_[up] -= many
            front, k = up[open_[up] == 0], k + 1
        return bool((self.level >= 0).all())

    def columns(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, packed bits): the nodes that reach one of the nodes ``start`` to ``stop``, in order, and which ones."""
        col = np.arange(start, stop)
        own = np.unique(self.root[col])
        seen = np.zeros(self.n, bool)
        seen[own] = True
        front = own
        while len(front):
            front = self.above[_lists(self.at_above, front)[0]]
            front = np.unique(front[~seen[front]])
            seen[front] = True
        use = np.flatnonzero(seen)
        place = np.full(self.n, -1)
        place[use] = np.arange(len(use))
        full = np.zeros((len(use), (stop - start + 7) // 8), np.uint8)
        np.bitwise_or.at(full, (place[self.root[col]], (col - start) >> 3), (128 >> ((col - start) & 7)).astype(np.uint8))
        order = use[np.argsort(self.level[use], kind="stable")]
        most = max(1, HELD // full.shape[1])
        for same in np.split(order, np.flatnonzero(np.diff(self.level[order])) + 1):
            cost = np.cumsum(self.at_below[same + 1] - self.at_below[same])
            for x in np.split(same, np.flatnonzero(np.diff(cost // most)) + 1):
                at, many = _lists(self.at_below, x)
                to, own_of = place[self.below[at]], np.repeat(place[x], many)
                to, own_of = to[to >= 0], own_of[to >= 0]
                if len(to):
                    first = np.flatnonzero(np.diff(own_of, prepend=-1))
                    full[own_of[first]] |= np.bitwise_or.reduceat(full[to], first, axis=0)
        nodes = np.flatnonzero(seen[self.root])
        bits = full[place[self.root[nodes]]]
        plain = np.flatnonzero((nodes >= start) & (nodes < stop) & ~self.cyclic[nodes])
        k = nodes[plain] - start
        bits[plain, k >> 3] &= ~(128 >> (k & 7)).astype(np.uint8)
        some = bits.any(axis=1)
        return nodes[some], bits[some]


def closure_tiles(edges: DataFrame, tile: int = TILE) -> DataFrame:
    """The tiles of everything a node reaches, (graph_id, n, i, j, bits), for numbered edges (graph_id, n, a, b) of graphs of any size.

    The columns of a graph's matrix are dealt to as many tasks as there are cores. A task holds the numbers of the graph's edges and
    about ``HELD`` bytes of bits (64 bytes a node at least), so what grows with the square of the nodes is time and tiles, not memory.
    """
    spark = edges.sparkSession
    ship(spark)
    deal = spark.sparkContext.defaultParallelism

    def made(k: str, n: int, share: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[str, int, int, int, bytes]]:
        blocks = -(-n // tile)
        shares = min(deal, blocks)
        width = tile * max(1, min(-(-blocks // shares), 8 * HELD // (n * tile)))
        matrix = _Matrix(n, a, b)
        for start in range(share * width, n, shares * width):
            stop = min(start + width, n)
            nodes, bits = matrix.columns(start, stop)
            ends = np.searchsorted(nodes, np.arange(0, n + tile, tile))
            for i in np.flatnonzero(np.diff(ends)).tolist():
                m = np.zeros((_side(n, i, tile), stop - start), np.uint8)
                m[nodes[ends[i] : ends[i + 1]] - i * tile] = np.unpackbits(bits[ends[i] : ends[i + 1]], axis=1, count=stop - start)
                for u in range(0, stop - start, tile):
                    if (x := m[:, u : u + tile]).any():
                        yield k, n, i, (start + u) // tile, zlib.compress(np.packbits(x).tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[str, int, int, int, bytes]] = []

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*kept, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=[g, "n", "i", "j", "bits"])
            kept.clear()
            return out

        for (k, share), n, a, b in _by_share(batches):
            for row in made(k, n, share, a, b):
                kept.append(row)
                if len(kept) >= KEPT:
                    yield rows()
        if kept:
            yield rows()

    shares = F.least(F.lit(deal), F.ceil(c("n") / tile)).cast("int")
    dealt = edges.select(g, F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "n", "a", "b")
    return materialize(dealt.repartition(4 * deal, g, "share").sortWithinPartitions(g, "share").mapInArrow(run, _TILES))


def _by_share(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, np.ndarray, np.ndarray]]:
    """((graph_id, share), n, a, b) of each share of a graph, from rows (graph_id, share, n, a, b) that are sorted by it."""
    key, n, parts = None, 0, []
    for batch in batches:
        k, share, size, a, b = batch.columns
        if not len(share):
            continue
        numbers = share.to_numpy()
        new = np.diff(numbers) != 0
        if len(k) > 1:
            new |= pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
        a, b = a.to_numpy().astype(np.int64), b.to_numpy().astype(np.int64)
        ends = [0, *(np.flatnonzero(new) + 1).tolist(), len(numbers)]
        for x, y in zip(ends, ends[1:]):
            at = k[x].as_py(), int(numbers[x])
            if at != key:
                if parts:
                    yield key, n, *(np.concatenate(p) for p in zip(*parts, strict=True))
                key, n, parts = at, size[x].as_py(), []
            parts.append((a[x:y], b[x:y]))
    if parts:
        yield key, n, *(np.concatenate(p) for p in zip(*parts, strict=True))


def tile_pairs(tiled: DataFrame, tile: int = TILE) -> DataFrame:
    """(graph_id, a, b): the numbered pairs whose bits are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n, i, j, bits in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                x, y = np.nonzero(unpacked(bits, n, i, j, tile))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), pa.string()), pa.array(x + i * tile, pa.int32()), pa.array(y + j * tile, pa.int32())], names=[g, "a", "b"])

    return tiled.select(g, "n", "i", "j", "bits").mapInArrow(run, f"{g} string, a int, b int")


def tile_degrees(tiled: DataFrame, weights: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(graph_id, id, k, pairs): for each node the nodes it is above or below, and their weights times its own over those it is below.

    ``weights`` (graph_id, block, weights), an array for each tile's side, says what a node counts; nodes of weight 0 take no part.
    Without weights each counts 1.
    """
    one = F.lit(None).cast("array<int>")
    if weights is None:
        x = tiled.select(g, "n", "i", "j", "bits", one.alias("p"), one.alias("q"))
    else:
        side = lambda block, name: weights.select(g, c("block").alias(block), c("weights").alias(name))
        x = tiled.join(side("i", "p"), [g, "i"]).join(side("j", "q"), [g, "j"]).select(g, "n", "i", "j", "bits", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n, i, j, bits, p, q in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                m = unpacked(bits, n, i, j, tile).astype(np.int64)
                p, q = (np.ones(s, np.int64) if v is None else np.array(v, np.int64) for v, s in zip((p, q), m.shape, strict=True))
                m = m * (p > 0)[:, None] * (q > 0)[None, :]
                ids = np.concatenate([np.arange(m.shape[0]) + i * tile, np.arange(m.shape[1]) + j * tile])
                degree, pairs = np.concatenate([m.sum(1), m.sum(0)]), np.concatenate([p * (m @ q), np.zeros(m.shape[1], np.int64)])
                use = np.flatnonzero(degree)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(use), pa.string()), pa.array(ids[use], pa.int32()), pa.array(degree[use]), pa.array(pairs[use])], names=[g, "id", "k", "pairs"])

    return x.mapInArrow(run, f"{g} string, id int, k long, pairs long").groupBy(g, "id").agg(F.sum("k").alias("k"), F.sum("pairs").alias("pairs"))
