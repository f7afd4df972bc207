"""N-gram Jaccard join by parity sketches: which texts have shingle sets of at least a given similarity.

A set is hashed into a parity sketch: each shingle flips one bit, so the Hamming distance of two sketches is at most the
symmetric difference of the sets. Sizes fall into bands; a band's sketch is cut into more parts than two linked sets of
that band can differ in, so linked sets agree in some part (pigeonhole) and meet in a join on (band, part, its bits). A set
offers only its fullest parts: as many as any partner may differ in and one more, with all parts of equal fullness. Of two
linked sets the one whose bar is higher offers enough parts for one to be equal, and the other offers it too. That keeps
nearly empty parts, which agree by chance, out of the join and loses no link.

Sets that meet in a bucket are first compared with one representative of it, by a short dense sketch (Hamming distance
against the largest difference allowed for their sizes), and with the first and the nearest of those that are close by exact
sets. In a large group of near copies that joins nearly all members at a cost of one row each. Pairs of close sets that were
not tried and are still in different components go on as they are. Only buckets that still hold several components go on: there the rest of a
bucket (all but its largest component) is compared with the whole bucket, by sketches and then within the clusters of close
sets by exact sets, and only sets of different components are. Large buckets and clusters are cut into chunks, and a task
sees two chunks at a time, of which one at least is of the rest; it returns a spanning forest of what it confirms, never all
pairs. Rows grow with a bucket's size, and beyond that with its rest times its size over the length of a chunk. Links that
only repeat what a path of verified links says are not listed, and no link between different texts is lost to the components.

Equal sets are one node from the start. Sets are told apart by 128 bits (a 64-bit name and a 64-bit check), words and
shingles by 64; signatures and names only propose candidates, so a collision among them costs a comparison and no link.

Edge cases: null or wordless texts have an empty set and are linked with nothing; a row without doc_id is linked with nothing
and has no component; rows of one doc_id count as one document, which has the links of each of its texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io
from . import _words as W
from .components import connected_components

SKETCH_BITS = 1024
#: Rows of the small side that may be broadcast; beyond it the join is left to a shuffle.
MOST_BROADCAST = 500_000
CHUNK = 128
CHUNK_TOKENS = 250_000


def text_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row of a block."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    words = W.hashes(data, starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(W.shingles(words[a:b], k))


def set_name(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set, as signed longs."""
    out = []
    for salt in (0xD6E8FEB86659FD93, 0x8BB84B93962EACC9):
        x = W.mix(s ^ W.U(salt))
        x = np.array([np.bitwise_xor.reduce(x), x.sum(dtype=np.uint64), len(s)], np.uint64)
        out.append(int(W.shingles(x, 3).astype(np.int64)[0]))
    return out[0], out[1]


def dense_sketch(s: np.ndarray) -> bytes:
    bits = np.bincount((s & W.U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(bool)).tobytes()


def largest_difference(total, percent: int):
    """The largest symmetric difference of two linked sets, from the sum of their sizes (numbers or arrays)."""
    return total - 2 * -(-percent * total // (100 + percent))


class Bands:
    """Size bands [lower, upper) and what a set offers in each band in which it may meet a partner."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]

    def _reach(self, size: int) -> None:
        while self.edges[-1] <= size:
            u = self.edges[-1]
            self.edges.append(max(u + 1, u * 10000 // (self.percent * self.percent)))

    def offers(self, s: np.ndarray) -> Iterator[np.ndarray]:
        """Signatures (uint64) of the parts that the sorted set ``s`` offers."""
        n, p = len(s), self.percent
        most = n * 100 // p
        self._reach(most)
        band = int(np.searchsorted(self.edges, n, "right")) - 1
        bits = W.mix(s ^ W.U(0xA5A5A5A55A5A5A5A))
        high = s >> W.U(32)
        while band < len(self.edges) - 1 and self.edges[band] <= most:
            upper = self.edges[band + 1] - 1
            differ = (n + min(upper, most)) * (100 - p) // (100 + p)
            if differ > 0:
                parts = (2 * upper * (100 - p) // (100 + p) + 1) * 5 // 4 + 1
                part = ((high * W.U(parts)) >> W.U(32)).astype(np.int64)
                fill = np.bincount(part, minlength=parts)
                bar = np.partition(fill, parts - 1 - differ)[parts - 1 - differ]
                used = np.flatnonzero(fill)
                value = np.zeros(parts, np.uint64)
                value[used] = np.bitwise_xor.reduceat(bits, (np.cumsum(fill) - fill)[used])
                pick = np.flatnonzero(fill >= bar)
                yield W.mix(value[pick] + W.mix((pick.astype(np.uint64) << W.U(20)) + W.U(band + 1)) + fill[pick].astype(np.uint64))
            band += 1


def _texts(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select(*extra, _io.text_or_empty().alias(_io.OWN + "text"))


def members(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, node, check, sketch) of every row; ``node`` and ``check`` name the set and are null without words."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(1)):
                sets = list(text_sets(data, offsets, k))
                names = [set_name(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), pa.array([dense_sketch(s) if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n", "node", "check", "sketch"],
                )

    return _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_io.lean(run), "doc_id long, n long, node long, check long, sketch binary")


def offers(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, node): the sketch parts that every set offers; a set that a task has seen before is left out."""

    def run(batches):
        bands, seen = Bands(percent), set()
        for batch in batches:
            for _, _, data, offsets in W.blocks(batch.column(0)):
                sigs, nodes = [], []
                for s in text_sets(data, offsets, k):
                    if len(s) and (name := set_name(s)) not in seen:
                        if len(seen) < 1 << 19:
                            seen.add(name)
                        for got in bands.offers(s):
                            sigs.append(got)
                            nodes.append(np.full(len(got), name[0], np.int64))
                if sigs:
                    sig, node = np.concatenate(sigs).view(np.int64), np.concatenate(nodes)
                    for a in range(0, len(sig), 65536):
                        yield pa.RecordBatch.from_arrays([pa.array(sig[a : a + 65536]), pa.array(node[a : a + 65536])], names=["sig", "node"])

    return _texts(docs.filter("doc_id is not null")).mapInArrow(_io.lean(run), "sig long, node long")


class Forest:
    """Union-find over positions; remembers roots."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def close_pairs(sizes: np.ndarray, sketches: np.ndarray, roots: np.ndarray, side: np.ndarray, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different roots (of one chunk, or across two) whose sizes and sketches allow a link, nearest first."""
    left, right = (np.arange(len(sizes)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(left) or not len(right):
        return left[:0], right[:0]
    distance = np.bitwise_count(sketches[left][:, None, :] ^ sketches[right][None, :, :]).sum(2, dtype=np.int64)
    a, b = sizes[left][:, None], sizes[right][None, :]
    ok = (np.maximum(distance, np.abs(a - b)) <= largest_difference(a + b, percent)) & (roots[left][:, None] != roots[right][None, :])
    if same:
        ok &= left[:, None] < right[None, :]
    x, y = np.nonzero(ok)
    order = np.argsort(distance[x, y], kind="stable")
    return left[x[order]], right[y[order]]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, of a sorted stream."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if rest and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
            last = key
    if rest:
        yield pa.Table.from_batches(rest)


def _sketches(table: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint64).reshape(table.num_rows, -1)


class _Found:
    """Edges between roots, handed out in batches; each group of rows returns a spanning forest of its own."""

    def __init__(self):
        self.rows: list[tuple[int, int]] = []

    def forest(self, roots: np.ndarray) -> tuple[Forest, np.ndarray]:
        """A forest over the distinct roots, and the place of each row's root in it."""
        self.names, at = np.unique(roots, return_inverse=True)
        return Forest(len(self.names)), at.ravel()

    def add(self, forest: Forest) -> None:
        self.rows += [(int(self.names[r]), int(self.names[x])) for x in range(len(self.names)) if (r := forest.find(x)) != x]

    def batch(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in self.rows], pa.int64()), pa.array([b for _, b in self.rows], pa.int64())], names=["a", "b"])
            self.rows = []


def _dealt(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows (key, root, doc, columns) of groups of several roots, dealt into pairs of chunks (i, j) of which one is of the rest.

    ``rows`` bring what ``_parts`` says of their group: the root that holds most of it and the numbers of chunks of the others
    and of it. Each row comes once for every pair of chunks that its own chunk is in; sorted by (key, i, j) within partitions.
    """
    minor = F.col("root") != F.col("major")
    zero = F.lit(0).cast("long")
    own = F.when(F.col("single"), zero).when(minor, F.pmod(F.xxhash64("doc"), F.col("minors"))).otherwise(F.col("minors") + F.pmod(F.xxhash64("doc"), F.col("majors")))
    last = F.when(F.col("single"), zero).when(minor, F.col("minors") + F.col("majors") - 1).otherwise(F.col("minors") - 1)
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(zero, last)))
    out = out.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "root", "doc", *columns)
    return out.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "doc")


def _parts(sizes: DataFrame, key: str) -> DataFrame:
    """(key, major, minors, majors, single) of groups of several roots, from rows (key, root, rows, tokens) of each root in a group."""
    chunks = lambda n, tokens: F.ceil(F.greatest(n / CHUNK, tokens / CHUNK_TOKENS, F.lit(1)))
    got = sizes.groupBy(key).agg(F.max_by("root", F.struct("rows", "root")).alias("major"), F.count("*").alias("roots"), F.sum("rows").alias("size"), F.sum("tokens").alias("all"), F.max(F.struct("rows", "root", "tokens")).alias("top")).filter("roots > 1")
    top, own = F.col("top.rows"), F.col("top.tokens")
    return got.select(key, "major", "size", chunks(F.col("size") - top, F.col("all") - own).alias("minors"), chunks(top, own).alias("majors"), ((F.col("size") <= CHUNK) & (F.col("all") <= CHUNK_TOKENS)).alias("single"))


def _close_roots(rows: DataFrame, percent: int) -> DataFrame:
    """Forest edges (a, b) of roots with close sketches, from rows (sig, i, j, side, root, doc, n, sketch)."""

    def run(batches):
        found = _Found()
        for t in _groups(batches, 3):
            roots = t.column("root").to_numpy()
            forest, at = found.forest(roots)
            x, y = close_pairs(t.column("n").to_numpy(), _sketches(t, "sketch"), roots, t.column("side").to_numpy(), t.column("i")[0] == t.column("j")[0], percent)
            for a, b in zip(at[x].tolist(), at[y].tolist(), strict=True):
                forest.join(a, b)
            found.add(forest)
            yield from found.batch(50_000)
        yield from found.batch()

    return rows.mapInArrow(_io.lean(run), "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct tokens are linked."""
    both = len(x) + len(y)
    shared = both - len(np.union1d(x, y))
    return 100 * shared >= percent * (both - shared)


def _linked_roots(rows: DataFrame, percent: int) -> DataFrame:
    """Forest edges (a, b) of roots that hold linked sets, from rows (cluster, i, j, side, root, doc, tokens)."""

    def run(batches):
        found = _Found()
        for t in _groups(batches, 3):
            roots = t.column("root").to_numpy()
            forest, at = found.forest(roots)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
            sketches = np.frombuffer(b"".join(map(dense_sketch, sets)), np.uint64).reshape(len(sets), -1)
            x, y = close_pairs(np.array([len(s) for s in sets], np.int64), sketches, roots, t.column("side").to_numpy(), t.column("i")[0] == t.column("j")[0], percent)
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                if forest.find(at[a]) != forest.find(at[b]) and linked(sets[a], sets[b], percent):
                    forest.join(at[a], at[b])
            found.add(forest)
            yield from found.batch(50_000)
        yield from found.batch()

    return rows.mapInArrow(_io.lean(run), "a long, b long")


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, d): pairs whose sizes and sketches allow a link, with the distance; from (a, b, n, m, x, y)."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                n, m = t.column("n").to_numpy(), t.column("m").to_numpy()
                d = np.maximum(np.bitwise_count(_sketches(t, "x") ^ _sketches(t, "y")).sum(1, dtype=np.int64), np.abs(n - m))
                ok = np.flatnonzero(d <= largest_difference(n + m, percent))
                yield pa.RecordBatch.from_arrays([t.column("a").take(pa.array(ok)), t.column("b").take(pa.array(ok)), pa.array(d[ok])], names=["a", "b", "d"])

    return pairs.mapInArrow(_io.lean(run), "a long, b long, d long")


def _linked_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are linked; from (a, b, x, y) with the tokens of both."""

    def run(batches):
        for t in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in t.column(c).to_pylist()] for c in ("x", "y"))
            ok = pa.array([r for r in range(t.num_rows) if linked(x[r], y[r], percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([t.column("a").take(ok), t.column("b").take(ok)], names=["a", "b"])

    return pairs.mapInArrow(_io.lean(run), "a long, b long")


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` (rows of a few longs) has at most ``MOST_BROADCAST`` rows."""
    return df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def small_side(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has been counted and is small."""
    return F.broadcast(df) if is_small(df) else df


def jaccard_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: linked are texts with 100 * shared >= percent * union of k-word shingles."""
    _io.bounded_batches(docs.sparkSession)
    member = _io.materialize(members(docs, k))
    named = member.filter("node is not null and doc_id is not null")
    node = _io.materialize(named.groupBy("node", "check").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("sketch").alias("sketch")))

    # sets that agree in a part, each with the representative of its bucket
    offered = _io.materialize(offers(docs, k, percent))
    shared = _io.materialize(offered.groupBy("sig").agg(F.min("node").alias("rep"), F.max("node").alias("top")).filter("rep <> top").select("sig", "rep"))
    met = _io.materialize(offered.join(shared, "sig").select("sig", "node", "rep"))
    _io.discard(offered, shared)

    # each set against representatives: the first of those that are close, and the nearest
    pairs = met.filter("node <> rep").select("node", "rep").distinct()
    side = lambda key, doc, n, sketch: node.select(F.col("node").alias(key), F.col("doc").alias(doc), F.col("n").alias(n), F.col("sketch").alias(sketch))
    pairs = pairs.join(side("node", "b", "m", "y"), "node").join(side("rep", "a", "n", "x"), "rep").filter(F.greatest("n", "m") * percent <= F.least("n", "m") * 100)
    candidates = _io.materialize(_near(pairs.select("a", "b", "n", "m", "x", "y"), percent))
    near = candidates.groupBy("b").agg(F.min("a").alias("first"), F.min(F.struct("d", "a")).alias("nearest"))
    near = _io.materialize(near.select("b", F.explode(F.array_distinct(F.array("first", "nearest.a"))).alias("a")))
    repeats = named.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    sets = _io.materialize(_sets(docs, near.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), node, k, repeats))
    tokens = lambda key, name: sets.select(F.col("doc").alias(key), F.col("tokens").alias(name))
    links = _linked_pairs(near.join(tokens("b", "y"), "b").join(tokens("a", "x"), "a").select("a", "b", "x", "y"), percent)
    first = _io.materialize(connected_components(links).select(F.col("node").alias("doc"), "root"))
    root = lambda key, name: first.select(F.col("doc").alias(key), F.col("root").alias(name))
    untried = candidates.join(near, ["a", "b"], "left_anti").join(root("a", "r"), "a", "left").join(root("b", "s"), "b", "left")
    untried = _io.materialize(untried.select(F.coalesce("r", "a").alias("a"), F.coalesce("s", "b").alias("b")).filter("a <> b").distinct())
    _io.discard(near, sets, candidates)

    # the rest of buckets that hold several components
    rooted = node.join(first, "doc", "left").select("node", "check", "doc", "n", "sketch", F.coalesce("root", "doc").alias("root"))
    left = _io.materialize(met.select("sig", "node").distinct().join(rooted.select("node", "doc", "root"), "node").select("sig", "doc", "root"))
    _io.discard(met)
    buckets = left.groupBy("sig", "root").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.xxhash64(F.lit("doc"), "doc").cast("decimal(38,0)")).alias("y"))
    several = _parts(buckets.withColumn("tokens", F.lit(0).cast("long")), "sig").filter("size > 2")  # of two, one is the representative: tried, or among the untried
    twins = buckets.groupBy("sig").agg(F.sum("rows").alias("rows"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")).groupBy("rows", "x", "y").agg(F.min("sig").alias("sig"))  # one of buckets with equal members
    several = _io.materialize(several.join(twins.select("sig"), "sig"))
    rest = left.join(small_side(several), "sig").join(node.select("doc", "n", "sketch"), "doc")
    close = _close_roots(_dealt(rest, "sig", "n", "sketch"), percent)

    # clusters of components that hold close sets, verified by their exact sets
    cluster = _io.materialize(connected_components(close.union(untried)).select(F.col("node").alias("root"), F.col("root").alias("cluster")))
    _io.discard(left, several)
    within = _io.materialize(rooted.select("doc", "n", "root").join(small_side(cluster), "root"))
    if within.limit(1).count():
        parts = _io.materialize(_parts(within.groupBy("cluster", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")), "cluster"))
        texts = within.select("cluster", "root", "doc").join(small_side(parts), "cluster").join(_sets(docs, within.select("doc"), node, k, repeats), "doc")
        joined = connected_components(_linked_roots(_dealt(texts, "cluster", "tokens"), percent))
        rooted = rooted.join(joined.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").withColumn("root", F.coalesce("further", "root"))

    out = member.select("doc_id", "n", "node", "check").join(rooted.select("node", "check", F.col("root").alias("label")), ["node", "check"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def _sets(docs: DataFrame, wanted: DataFrame, node: DataFrame, k: int, repeats: bool) -> DataFrame:
    """(doc, tokens) of the documents in ``wanted`` (doc), each with the set that it stands for in ``node``, once each.

    ``repeats`` says that several rows may have one doc_id.
    """
    named = node.select("doc", F.col("node").alias("first"), F.col("check").alias("second")).join(wanted, "doc", "left_semi")
    named = _io.materialize(named)

    def run(batches):
        for batch in batches:
            first, second = batch.column("first").to_pylist(), batch.column("second").to_pylist()
            for i, j, data, offsets in W.blocks(batch.column("text")):
                sets = list(text_sets(data, offsets, k))
                ok = [r for r, s in enumerate(sets) if len(s) and set_name(s) == (first[i + r], second[i + r])]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(i, j - i).take(pa.array(ok, pa.int64())), pa.array([sets[r].tobytes() for r in ok], pa.binary())], names=["doc", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), _io.text_or_empty().alias("text"))
    out = texts.join(small_side(named), "doc").mapInArrow(_io.lean(run), "doc long, tokens binary")
    return out.dropDuplicates(["doc", "tokens"]) if repeats else out


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_io.read(spark, sf_dir, "documents"), 3, 90)
