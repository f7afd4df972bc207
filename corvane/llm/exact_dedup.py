"""Exact dedup by two passes of a Bloom filter.

The first pass hashes the normalised text of every row (A-Z lower-cased, SHA-256) and sets a few bits for each hash in a
filter that knows of each bit whether it was set once or more often. Partial filters of tasks are merged segment by segment.
The second pass asks the filter: a row whose bits were not all set more than once has a text of its own and passes straight
through. Only the other rows shuffle, with id and hash; equal hashes among them are grouped exactly, so a false alarm
of the filter costs a shuffled row and never changes a result.

Size. A filter has ``BITS_A_ROW`` bits a row and ``MOST_BITS`` at most, which bounds what the driver merges and what is
broadcast (``MOST_BITS`` / 8 bytes). A larger corpus is worked on in slices of the hashes' range, each with a filter of its
own; the table of hashes is sorted by hash within each file, so that a slice reads its own pages only. Groups that
hold more than a share of all suspected rows are few (at most ``MOST_HOT``) and meet their rows by a broadcast; the rest
by a shuffled join, in which no key has more rows than that share.

Edge cases: null text counts as empty; empty texts are equal; a row without id never wins over one with an id, and where no
row of a group has an id all of them stay, with a null ``__cv_keep_id``; rows that share the largest id of a group stay
together; an empty table gives an empty result; extra columns are kept and helper columns start with ``__cv_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _words as W

BITS_A_ROW, PROBES = 8, 3
#: Bits of a filter at most.
MOST_BITS = 1 << 28
#: Bytes of a filter that travel in one row.
SEGMENT = 1 << 16
#: Groups that may be broadcast.
MOST_HOT = 20_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: str = "text") -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(_io.text_or_empty(text), _UPPER, _UPPER.lower())


def places(names: np.ndarray, bits: int) -> np.ndarray:
    """(rows, PROBES): the bits of 64-bit names in a filter of ``bits`` (a power of two)."""
    a = W.mix(names.view(np.uint64) ^ W.U(0x9E3779B97F4A7C15))
    step = (a >> W.U(32)) | W.U(1)
    return (a[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & W.U(bits - 1)


class Filter:
    """Bits that were set once at least, and bits that were set twice at least."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def _bytes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of bytes and their new bits, from ascending distinct bits."""
        if not len(at):
            return at.astype(np.int64), np.zeros(0, np.uint8)
        byte, bit = (at >> W.U(3)).astype(np.int64), np.uint8(1) << (at & W.U(7)).astype(np.uint8)
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        return byte[first], np.bitwise_or.reduceat(bit, first)

    def add(self, names: np.ndarray) -> None:
        at, times = np.unique(places(names, self.bits), return_counts=True)
        byte, bits = self._bytes(at[times > 1])
        self.twice[byte] |= bits
        byte, bits = self._bytes(at)
        self.twice[byte] |= self.once[byte] & bits
        self.once[byte] |= bits


def repeated(twice: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether all bits of each name were set more than once."""
    at = places(names, len(twice) * 8)
    return (twice[(at >> W.U(3)).astype(np.int64)] >> (at & W.U(7)).astype(np.uint8) & np.uint8(1)).all(1)


def _partial(names: DataFrame, bits: int) -> DataFrame:
    """(segment, once, twice): the parts of each task's filter that are not empty; from rows (name)."""
    size = min(SEGMENT, bits // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(bits)
        for batch in batches:
            f.add(batch.column(0).to_numpy())
        for k in range(0, bits // 8, size):
            if f.once[k : k + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([f.once[k : k + size].tobytes()], pa.binary()), pa.array([f.twice[k : k + size].tobytes()], pa.binary())], names=["segment", "once", "twice"])

    return names.mapInArrow(_io.lean(run), "segment int, once binary, twice binary")


def _merged(parts: DataFrame) -> DataFrame:
    """(segment, twice) of all tasks together. A task holds the segments dealt to it, all of one filter at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
                if k not in held:
                    held[k] = one.copy(), two.copy()
                    continue
                once, twice = held[k]
                twice |= two
                twice |= once & one
                once |= one
        for k, (_, twice) in held.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["segment", "twice"])

    return parts.repartition("segment").mapInArrow(_io.lean(run), "segment int, twice binary")


def _suspected(spark: SparkSession, names: DataFrame, rows: int):
    """A function of a Column of names: whether the name may occur more than once among ``names``."""
    bits = 1 << max(10, min(MOST_BITS, BITS_A_ROW * rows) - 1).bit_length()
    bits = min(bits, MOST_BITS)
    twice = np.zeros(bits // 8, np.uint8)
    for r in _merged(_partial(names, bits)).toLocalIterator():  # MOST_BITS / 8 bytes in all
        part = np.frombuffer(r.twice, np.uint8)
        twice[r.segment * SEGMENT : r.segment * SEGMENT + len(part)] = part
    sent = spark.sparkContext.broadcast(twice)

    @F.pandas_udf("boolean")
    def asked(name: pd.Series) -> pd.Series:
        return pd.Series(repeated(sent.value, name.to_numpy()))

    return asked


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: list[str] | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """``keep`` (all columns if None) with ``__cv_keep_id``, ``__cv_group_size``, ``__cv_kept`` and ``__cv_sha256`` (binary), one row for each row of ``docs``.

    The columns in ``keep`` are written once to the shared folder beside the hashes; leave the text out to have only ids there.
    """
    spark = docs.sparkSession
    _io.bounded_batches(spark, rows=10_000)
    sha, name, own = _io.OWN + "sha256", _io.OWN + "name", _io.OWN + "id"
    carried = [f"`{c}`" for c in (docs.columns if keep is None else keep)]
    table = docs.select(*carried, F.col(id).alias(own), F.unhex(F.sha2(normalised(text), 256)).alias(sha))
    table = table.withColumn(name, F.conv(F.hex(F.substring(sha, 1, 7)), 16, 10).cast("long"))  # 56 bits
    table = _io.materialize(table.sortWithinPartitions(name))
    n = table.count()
    slices = max(1, -(-BITS_A_ROW * n // most_bits))
    edges = [(k << 56) // slices for k in range(slices + 1)]
    alone, again = [], []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = table if slices == 1 else table.filter((F.col(name) >= low) & (F.col(name) < high))
        asked = _suspected(spark, part.select(name), -(-n // slices))
        alone.append(part.filter(~asked(name)))
        again.append(part.filter(asked(name)))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    suspects = union(again)
    groups = _io.materialize(suspects.groupBy(sha).agg(F.max(own).alias(_io.OWN + "keep_id"), F.count("*").alias(_io.OWN + "group_size")))
    size = F.col(_io.OWN + "group_size")
    share = max(64, -(-(groups.agg(F.sum(size)).first()[0] or 0) // MOST_HOT))
    hot, cold = F.broadcast(groups.filter(size >= share)), groups.filter(size < share)
    straight = union(alone).withColumns({_io.OWN + "keep_id": F.col(own), _io.OWN + "group_size": F.lit(1).cast("long")})
    out = straight.unionByName(suspects.join(hot, sha)).unionByName(suspects.join(hot.select(sha), sha, "left_anti").join(cold, sha))
    return out.withColumn(_io.OWN + "kept", F.col(own).eqNullSafe(F.col(_io.OWN + "keep_id"))).select(*carried, *[_io.OWN + c for c in ("keep_id", "group_size", "kept", "sha256")])


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(_io.read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", *[F.col(_io.OWN + c).alias(c) for c in ("keep_id", "group_size", "kept")], F.lower(F.hex(_io.OWN + "sha256")).alias("text_sha256"))


ORACLE = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) AS h FROM documents)
WINDOW w AS (PARTITION BY h)
"""
