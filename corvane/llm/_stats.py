"""Per-text statistics that the quality rules and the quality classifier share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _io
from . import _words as W

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "n_upper_words", "n_upper", "n_lower", "n_digits", "n_stops", "n_marks", "n_bars", "n_word_bytes_over_20",
)

_CLASS = {
    "n_symbols": b"#*$%&|<>",
    "n_digits": b"0123456789",
    "n_stops": b".?",
    "n_marks": b"!",
    "n_bars": b"|",
}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))


def _equal_to_earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key stands earlier too; the key stands anywhere else too."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return later, any_


def block_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of the rows of one block, as int64."""
    n = len(offsets) - 1
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    row = W.rows_of(first)
    words = W.hashes(data, starts, ends)
    salt = W.mix(row.astype(np.uint64) + W.U(1))
    out = {"n_words": np.diff(first)}
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    out["word_chars"] = total[first[1:]] - total[first[:-1]] - _per_row((data & 0xC0) == 0x80, offsets)
    for name, chars in _CLASS.items():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        out[name] = _per_row(table[data], offsets)

    ls, le, lfirst = W.lines(data, offsets)
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    lrow = W.rows_of(lfirst)[has]
    ls, le = ls[has], le[has]
    later, _ = _equal_to_earlier(W.hashes(data, ls, le) + W.mix(lrow.astype(np.uint64) + W.U(1)))
    out["n_dup_lines"] = np.bincount(lrow[later], minlength=n)
    out["n_lines"] = np.bincount(lrow, minlength=n)

    later, _ = _equal_to_earlier(words + salt)
    out["n_distinct_words"] = out["n_words"] - np.bincount(row[later], minlength=n)
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        key = W.shingles(words, 3) + salt[:-2]
        whole = np.flatnonzero(row[:-2] == row[2:])  # windows within one text
        at = whole[_equal_to_earlier(key[whole])[1]]
        for i in range(3):
            covered[at + i] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)

    upper, lower = (data >= 0x41) & (data <= 0x5A), (data >= 0x61) & (data <= 0x7A)
    up, low = np.flatnonzero(upper), np.flatnonzero(lower)
    out["n_upper"], out["n_lower"] = np.diff(np.searchsorted(up, offsets)), np.diff(np.searchsorted(low, offsets))
    if len(starts):
        ups = np.add.reduceat(np.append(upper, False).view(np.int8), np.stack([starts, ends], 1).ravel(), dtype=np.int32)[::2]
        lows = np.add.reduceat(np.append(lower, False).view(np.int8), np.stack([starts, ends], 1).ravel(), dtype=np.int32)[::2]
        loud = (ups >= 2) & (lows == 0)
    else:
        loud = np.zeros(0, bool)
    out["n_upper_words"] = np.bincount(row[loud], minlength=n)
    out["n_word_bytes_over_20"] = np.bincount(row[(ends - starts) > 20], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def with_stats(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) and ``__cv_<stat>`` longs for the whole text of every row; null counts as empty."""
    keep = df.columns if keep is None else keep
    _io.bounded_batches(df.sparkSession)
    own = [_io.OWN + s for s in STATS]
    carried = [f for f in df.select(*[f"`{c}`" for c in keep]).schema.fields]
    schema = T.StructType([*carried, *[T.StructField(c, T.LongType(), False) for c in own]])
    source = df.select(*[f"`{c}`" for c in keep], _io.text_or_empty(text).alias(_io.OWN + "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for i, j, data, offsets in W.blocks(column):
                got = block_stats(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)), *(pa.array(got[s]) for s in STATS)], names=[*keep, *own])

    return source.mapInArrow(_io.lean(run), schema)
