"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of 13 consecutive words of every benchmark item (an item of fewer words is one window). The search
reads the last two words of the window in hand: a shift table tells how far the window may move at once, most often by
twelve words. Where the shift is 0, the suffix's hash picks a bucket of test strings, and comparing words confirms.

Documents are never shuffled or dropped: one pass, in which only the benchmark's patterns travel. They are made from blocks of
at most ``block_bytes`` of benchmark text; a larger benchmark takes one more pass over the documents for each further block,
and the table between two passes is written to the shared folder, so that one block's patterns are alive at a time. Test
strings are places in the block's own words and all else is arrays: a block of 8 MB of text (1.4 million words) took 75 MB in a worker.

Edge cases: null or empty documents have no words and no hits; items without words have no window; rows of the benchmark
without an id are left out; ids may be of any integer type or strings; repeated items count once by id, equal windows of
several items hit all of them; an empty benchmark hits nothing; repeated documents give equal rows; extra columns are kept
and helper columns start with ``__cv_``.
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

WINDOW = 13
SEGMENT = 256


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cheap 64-bit keys of words from their length and four of their bytes; equal words have equal keys."""
    size = ends - starts
    x = data[starts].astype(np.uint64) | data[ends - 1].astype(np.uint64) << W.U(8)
    x |= data[starts + size // 2].astype(np.uint64) << W.U(16)
    x |= data[starts + size // 3].astype(np.uint64) << W.U(24)
    return x | size.astype(np.uint64) << W.U(32)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix(a * W.U(0x9E3779B97F4A7C15) + b)


class Words:
    """The lower-cased words of some texts, joined by blanks: bytes, places, hashes, and where each text begins."""

    def __init__(self, texts: list[str | None]):
        parts, sizes = [], []
        for t in texts:
            data = W.LOWER[np.frombuffer((t or "").encode(), np.uint8)]
            starts, ends, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM)
            raw = data.tobytes()
            parts += [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            sizes.append(len(starts))
        self.raw = b" ".join(parts)
        ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64)) - 1
        self.ends = ends.astype(np.int32)
        self.starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)].astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data = np.frombuffer(self.raw, np.uint8)
        self.names = W.hashes(data, self.starts, self.ends)
        self.keys = _word_keys(data, self.starts, self.ends)


def _named(words: list[np.ndarray]) -> np.ndarray:
    """A hash of consecutive words, from the hashes of the first words, the second ones and so on."""
    x = np.zeros(len(words[0]), np.uint64)
    for w in words:
        x = (x + w) * W.U(0x9FB21C651E98DF25)
        x ^= x >> W.U(32)
    return W.mix(x)


class Patterns:
    """Shift table and suffix buckets of the windows of one length ``m`` (in words) of some items."""

    def __init__(self, m: int, words: Words, items: np.ndarray):
        self.m, self.depth = m, min(2, m)
        size = words.first[items + 1] - words.first[items]
        at = np.repeat(words.first[items] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())  # all words of the items
        place = at - np.repeat(words.first[items], size)
        bits = max(12, int(np.ceil(np.log2(8 * len(at) + 1))))
        self.mask = W.U((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.depth + 1, np.uint8)
        inner = place >= self.depth - 1  # the block that ends at word i of an item ends a window, or is m - 1 - i words from the end of the first one
        h = self.block(words.keys[at[inner] - 1] if self.depth == 2 else None, words.keys[at[inner]])
        np.minimum.at(self.shift, (h & self.mask).astype(np.int64), np.maximum(m - 1 - place[inner], 0).astype(np.uint8))

        begins = at[place <= np.repeat(size, size) - m]
        owner = np.repeat(items, size - m + 1)
        name = _named([words.names[begins + i] for i in range(m)])
        order = np.lexsort((begins, name))
        begins, owner, name = begins[order], owner[order], name[order]
        self.raw, starts, ends = words.raw, words.starts, words.ends
        new = np.ones(len(begins), bool)
        new[1:] = name[1:] != name[:-1]
        heads = np.append(np.flatnonzero(new), len(begins))
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            if b - a > 1:  # windows of one hash are one test string if their words are equal, too
                text = lambda k: self.raw[starts[begins[k]] : ends[begins[k] + m - 1]]
                own = sorted(range(a, b), key=text)
                texts = [text(k) for k in own]
                begins[a:b], owner[a:b] = begins[own], owner[own]
                new[a + 1 : b] = [x != y for x, y in zip(texts[1:], texts[:-1], strict=True)]
        group = np.cumsum(new) - 1
        held = np.unique(group * (len(words.first) + 1) + owner)
        group_of, self.owner = held // (len(words.first) + 1), (held % (len(words.first) + 1)).astype(np.int32)
        begins = begins[new]
        self.suffix = self.block(words.keys[begins + m - 2] if self.depth == 2 else None, words.keys[begins + m - 1])
        order = np.lexsort((name[new], self.suffix))  # the test strings of a suffix hash, ordered by their own
        self.suffix, self.name = self.suffix[order], name[new][order]
        self.text = np.stack([starts[begins], ends[begins + m - 1]], 1)[order]
        edges = np.searchsorted(group_of, np.arange(len(begins) + 1)).astype(np.int32)
        self.held = np.stack([edges[:-1], edges[1:]], 1)[order]

    def block(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return W.mix(last) if before is None else _pair(before, last)

    def candidates(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words of windows whose shift is 0, and their suffix hashes. All rows are walked at once, in segments."""
        n = np.diff(first)
        rows = np.flatnonzero(n >= self.m)
        parts = (n[rows] - self.m) // SEGMENT + 1
        row = np.repeat(rows, parts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = first[row] + self.m - 1 + k * SEGMENT
        end = np.minimum(at + SEGMENT, first[row + 1])
        found, suffixes = [], []
        while len(at):
            last = _word_keys(data, starts[at], ends[at])
            h = self.block(_word_keys(data, starts[at - 1], ends[at - 1]) if self.depth == 2 else None, last)
            step = self.shift[(h & self.mask).astype(np.int64)]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                suffixes.append(h[hit])
            at = at + np.maximum(step, 1)
            on = at < end
            if not on.all():
                at, end = at[on], end[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(found), np.concatenate(suffixes)

    def occurrences(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of confirmed windows, and the test string's number."""
        at, suffixes = self.candidates(data, starts, ends, first)
        left, right = (np.searchsorted(self.suffix, suffixes, side) for side in ("left", "right"))
        ok = left < right
        at, left, right = at[ok], left[ok], right[ok]
        a = at - self.m + 1
        name = _named([W.hashes(data, starts[a + i], ends[a + i]) for i in range(self.m)])
        begins, which = [], []
        for begin, x, lo, hi in zip(a.tolist(), name, left.tolist(), right.tolist(), strict=True):
            lo += int(np.searchsorted(self.name[lo:hi], x))
            while lo < hi and self.name[lo] == x:
                s, e = self.text[lo]
                if self.raw[s:e] == b" ".join([raw[s:e] for s, e in zip(starts[begin : begin + self.m].tolist(), ends[begin : begin + self.m].tolist(), strict=True)]):
                    begins.append(begin)
                    which.append(lo)
                    break
                lo += 1
        return np.array(begins, np.int64), np.array(which, np.int64)

    def items_of(self, k: int) -> np.ndarray:
        a, b = self.held[k]
        return self.owner[a:b]


def build(items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[list, list[Patterns]]:
    """The items' ids, and pattern tables of their windows, one a length."""
    words = Words([t for _, t in items])
    length = np.minimum(np.diff(words.first), window)
    return [i for i, _ in items], [Patterns(int(m), words, np.flatnonzero(length == m)) for m in np.unique(length) if m]


def scan_block(ids: list, patterns: list[Patterns], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Where each row's words begin, hit flags of all words, and the ids of the items found in each row."""
    data = W.LOWER[data]
    raw = data.tobytes()
    starts, ends, first = W.spans(data, offsets, W.ALNUM)
    change = np.zeros(len(starts) + 1, np.int64)
    items: list[set] = [set() for _ in range(len(offsets) - 1)]
    for p in patterns:
        begins, which = p.occurrences(data, raw, starts, ends, first)
        if len(begins):
            np.add.at(change, begins, 1)
            np.add.at(change, begins + p.m, -1)
            for row, k in set(zip((np.searchsorted(first, begins, "right") - 1).tolist(), which.tolist(), strict=True)):
                items[row].update(ids[x] for x in p.items_of(k).tolist())
    return first, np.cumsum(change[:-1]) > 0, items


def _item_blocks(bench: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for item, text in bench.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        block.append((item, text))
        size += len(text)
        if size > block_bytes:
            yield block
            block, size = [], 0
    yield block


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = 8 << 20) -> DataFrame:
    """``keep`` (all columns if None) with ``__cv_n_words``, ``__cv_n_hit`` (long) and ``__cv_items`` (sorted array of item ids: longs, or strings if the ids are no integers)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    _io.bounded_batches(spark)
    quoted = [f"`{c}`" for c in keep]
    id_type = T.LongType() if isinstance(bench.schema["item_id"].dataType, T.IntegralType) else T.StringType()
    bench = bench.withColumn("item_id", F.col("item_id").cast(id_type))
    own = [_io.OWN + c for c in ("n_words", "n_hit", "items", "marks")]
    fields = [T.StructField(own[0], T.LongType()), T.StructField(own[1], T.LongType()), T.StructField(own[2], T.ArrayType(id_type)), T.StructField(own[3], T.BinaryType())]
    df = docs.select(*quoted, _io.text_or_empty(text).alias(_io.OWN + "text"))
    carried = list(df.schema.fields)
    blocks, k = _item_blocks(bench, block_bytes), 0
    block = next(blocks)
    while block is not None:  # one block's patterns at a time on the driver
        shared, block = spark.sparkContext.broadcast(build(block, window)), next(blocks, None)
        last = block is None
        width = len(carried) - last
        schema = T.StructType([*carried[:width], *(fields[:3] if last else fields)])
        before, df = df, df.mapInArrow(_io.lean(_scanner(shared, len(carried), width, k > 0, last, schema.names, id_type)), schema)
        if not last:
            df = _io.materialize(df)
            shared.destroy()
            _io.discard(before)
        k += 1
    return df


def _scanner(shared, n_carried: int, width: int, again: bool, last: bool, names: list[str], id_type: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, patterns = shared.value
        kind = pa.list_(pa.string() if isinstance(id_type, T.StringType) else pa.int64())
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(n_carried - 1)):
                first, hit, items = scan_block(ids, patterns, data, offsets)
                if again:  # what earlier blocks of the benchmark hit
                    for r in range(j - i):
                        items[r].update(batch.column(n_carried + 2)[i + r].as_py())
                        n = first[r + 1] - first[r]
                        hit[first[r] : first[r + 1]] |= np.unpackbits(np.frombuffer(batch.column(n_carried + 3)[i + r].as_py(), np.uint8), count=n).astype(bool)
                sums = np.concatenate([[0], np.cumsum(hit)])
                out = [pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array([sorted(x) for x in items], kind)]
                if not last:
                    out.append(pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(width)), *out], names=names)

    return run


def contaminated():
    """The contamination rule: some word is hit, and hit words are at least one in twenty."""
    n, hit = F.col(_io.OWN + "n_words"), F.col(_io.OWN + "n_hit")
    return (hit > 0) & (20 * hit >= n)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_io.read(spark, sf_dir, "documents"), _io.read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.col(_io.OWN + "items")
    return out.select(
        "doc_id",
        F.col(_io.OWN + "n_words").alias("n_words"),
        F.col(_io.OWN + "n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
