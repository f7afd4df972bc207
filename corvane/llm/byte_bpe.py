"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by a vectorised reading of the pattern's character classes. A minimal perfect hash over the
vocabulary (hash and displace, checked against the token's own hash and bytes) resolves pre-tokens that are tokens; any other
pre-token is merged by rank with a heap over a linked list of its bytes. A worker remembers pre-tokens it has resolved.
Every encoding is decoded again; should the bytes differ, the text is encoded anew without hashes.

Only the vocabulary travels to the workers; its size is checked against ``MOST_VOCABULARY_BYTES``.

Edge cases: null and empty texts have no ids and decode to no bytes; bytes that are not UTF-8 are read as U+FFFD; special
tokens are ordinary text; a null array of ids decodes to null; ids outside the vocabulary raise an error; repeated rows
give equal results; extra columns are kept and helper columns start with ``__cv_``.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io
from . import _words as W

MOST_VOCABULARY_BYTES = 64 << 20
MOST_REMEMBERED = 200_000

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_cache: dict[object, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        text = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(text) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than what is sent to workers")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}


def _hash_all(tokens: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(t) for t in tokens])
    return W.hashes(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


class PerfectHash:
    """A minimal perfect hash of n distinct 64-bit keys onto 0..n-1: each bucket of about four keys has a displacement."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (keys % W.U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.displace = np.zeros(self.buckets, np.uint64)
        self.slots = np.full(n, -1, np.int64)
        free = [True] * n
        for b in np.argsort(-(np.diff(edges)), kind="stable").tolist():
            mine = order[edges[b] : edges[b + 1]]
            if not len(mine):
                break
            d, step = 0, 64
            while True:  # a run of displacements at once
                tries = self._place(keys[mine][None, :], np.arange(d, d + step, dtype=np.uint64)[:, None])
                for k, row in enumerate(tries.tolist()):
                    if all(free[s] for s in row) and len(set(row)) == len(row):
                        break
                else:
                    d, step = d + step, min(65536, step * 2)
                    continue
                break
            self.displace[b] = d + k
            for s, key in zip(row, mine.tolist(), strict=True):
                free[s] = False
                self.slots[s] = key
        self.at_slot = keys[self.slots] if n else keys

    def _place(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (W.mix(keys + d * W.U(0x9E3779B97F4A7C15)) % W.U(max(1, self.n))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        slot = self._place(keys, self.displace[(keys % W.U(self.buckets)).astype(np.int64)])
        return np.where(self.at_slot[slot] == keys, self.slots[slot], -1)


def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    if "classes" not in _cache:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                out[c] = LETTER
            elif k == "N":
                out[c] = NUMBER
        out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _cache["classes"] = out
    return _cache["classes"]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of every row, and where each row's pre-tokens begin. The bytes must be UTF-8."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    ascii_only = len(lead) == len(data)
    points = data if ascii_only else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    cls = _classes()[points]
    rows = offsets if ascii_only else np.searchsorted(lead, offsets)
    new_row = np.zeros(len(points) + 1, bool)
    new_row[rows] = True
    edge = new_row[:-1].copy()
    edge[0] = True
    edge[1:] |= cls[1:] != cls[:-1]
    rs = np.flatnonzero(edge)
    re_ = np.append(rs[1:], len(points))
    rc = cls[rs]
    is_space = rc == SPACE
    follows = ~new_row[re_]  # another run of the row follows
    blank_end = is_space & (points[re_ - 1] == 0x20) & follows  # its last blank goes to the next token
    lent = np.zeros(len(rs), bool)
    lent[1:] = blank_end[:-1]

    start = np.zeros(len(points) + 1, bool)
    words = ~is_space
    start[rs[words] - lent[words]] = True
    one = re_ - rs == 1
    start[rs[is_space & ~(one & blank_end)]] = True
    start[re_[is_space & ~blank_end & follows & ~one] - 1] = True

    quote = np.flatnonzero((rc == OTHER) & one & (points[rs] == 0x27) & ~lent & follows)  # 's 't 're 've 'm 'll 'd
    if len(quote):
        quote = quote[rc[np.minimum(quote + 1, len(rc) - 1)] == LETTER]
        a = re_[quote]
        p1 = points[a]
        p2 = np.where(re_[quote + 1] - a >= 2, points[np.minimum(a + 1, len(points) - 1)], 0)
        short = np.isin(p1, [0x73, 0x74, 0x6D, 0x64])
        long = ((p1 == 0x72) | (p1 == 0x76)) & (p2 == 0x65) | (p1 == 0x6C) & (p2 == 0x6C)
        size = np.where(short, 1, np.where(long, 2, 0))
        ok = size > 0
        start[a[ok]] = False
        rest = a[ok] + size[ok]
        start[rest[rest < re_[quote[ok] + 1]]] = True
    at = np.flatnonzero(start[:-1])
    return (at if ascii_only else lead[at]), np.searchsorted(at, rows)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of least rank is merged first, the leftmost among equals."""
    n = len(piece)
    start, end = list(range(n)), list(range(1, n + 1))
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or end[i] != middle or end[j] != stop:
            continue
        end[i], alive[j], right[i] = end[j], False, right[j]
        if right[i] >= 0:
            left[right[i]] = i
            k = right[i]
            if (r := ranks.get(piece[start[i] : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[k]))
        h = left[i]
        if h >= 0 and (r := ranks.get(piece[start[h] : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[h], end[i]))
    return [ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i]]


class Coder:
    """Encodes and decodes blocks of texts; lives in a worker."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash):
        self.ranks, self.table = ranks, table
        self.tokens = list(ranks)
        self.ids = np.array(list(ranks.values()), np.int64)
        self.by_id = {i: t for t, i in ranks.items()}
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[int, int] = {}
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _resolve(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Remember the ids of new pre-tokens."""
        where = self.table.find(keys)
        flat, counts = [], []
        for piece, k in zip(pieces, where.tolist(), strict=True):
            ids = [int(self.ids[k])] if k >= 0 and self.tokens[k] == piece else [self.ranks[piece]] if piece in self.ranks else merge_bytes(piece, self.ranks)
            flat += ids
            counts.append(len(ids))
        base = len(self.count)
        self.seen.update(zip(keys.tolist(), range(base, base + len(pieces)), strict=True))
        counts = np.array(counts, np.int64)
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.pool = np.concatenate([self.pool, np.array(flat, np.int32)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's ids begin, bytes, offsets): the last two are the UTF-8 that was read."""
        try:
            starts, first = pretokens(data, offsets)
        except UnicodeDecodeError:
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            starts, first = pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), data, offsets
        ends = np.append(starts[1:], len(data))
        keys, at, which = np.unique(W.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.seen) > MOST_REMEMBERED:
            self._forget()
        known = np.array([self.seen.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            raw = data.tobytes()
            base = len(self.count)
            self._resolve(keys[new], [raw[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            known[new] = base + np.arange(len(new))
        entry = known[which]
        counts = self.count[entry]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(self.first[entry] - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[first], data, offsets

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))

    def slow(self, text: bytes) -> list[int]:
        """One text without hashes."""
        data = np.frombuffer(text, np.uint8)
        starts, _ = pretokens(data, np.array([0, len(data)]))
        out: list[int] = []
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(data)).tolist(), strict=True):
            piece = text[a:b]
            out += [self.ranks[piece]] if piece in self.ranks else merge_bytes(piece, self.ranks)
        return out

    def round_trip(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(ids of all rows, where each row's ids begin, decoded bytes of each row), checked against the text."""
        ids, first, data, offsets = self.encode(data, offsets)
        raw = data.tobytes()
        decoded, wrong = [], {}
        for r, (a, b, s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            got = self.decode(ids[a:b])
            if got != raw[s:e]:  # two pre-tokens with one hash
                wrong[r] = np.array(self.slow(raw[s:e]), np.int32)
                got = self.decode(wrong[r])
            decoded.append(got)
        if wrong:
            rows = [wrong.get(r, ids[first[r] : first[r + 1]]) for r in range(len(decoded))]
            ids, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return ids, first, decoded


def _coder(shared) -> Coder:
    """The coder of a shared vocabulary. A worker that is used again holds one coder and not those of earlier queries."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if _cache.get("coder", (None,))[0] != key:
        _cache.pop("coder", None)
        _cache["coder"] = key, Coder(*shared.value)
    return _cache["coder"][1]


def _share(spark: SparkSession, ranks: dict[bytes, int]):
    _io.bounded_batches(spark)
    return spark.sparkContext.broadcast((ranks, PerfectHash(_hash_all(list(ranks)))))


def encode(df: DataFrame, ranks: dict[bytes, int], text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """``keep`` (all columns if None) with ``__cv_ids`` (array of int) and, if asked, ``__cv_decoded`` (binary), made from the ids."""
    keep = df.columns if keep is None else keep
    shared = _share(df.sparkSession, ranks)
    source = df.select(*[f"`{c}`" for c in keep], _io.text_or_empty(text).alias(_io.OWN + "text"))
    own = [T.StructField(_io.OWN + "ids", T.ArrayType(T.IntegerType(), False), False), T.StructField(_io.OWN + "decoded", T.BinaryType(), False)][: 1 + decoded]
    schema = T.StructType([*source.schema.fields[:-1], *own])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        kind = pa.list_(pa.field("element", pa.int32(), False))
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(batch.num_columns - 1)):
                ids, first, texts = coder.round_trip(data, offsets)
                out = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()), kind)]
                if decoded:
                    out.append(pa.array(texts, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)), *out], names=names)

    return source.mapInArrow(_io.lean(run), schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = _io.OWN + "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) with ``__cv_decoded``: the bytes of an array of ids."""
    keep = df.columns if keep is None else keep
    shared = _share(df.sparkSession, ranks)
    source = df.select(*[f"`{c}`" for c in keep], F.col(f"`{ids}`").cast("array<int>").alias(_io.OWN + "in"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(_io.OWN + "decoded", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            n = batch.num_columns - 1
            column = batch.column(n)
            texts = [None if x is None else b"".join(map(coder.by_id.__getitem__, x)) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n)), pa.array(texts, pa.binary())], names=names)

    return source.mapInArrow(_io.lean(run), schema)


def default_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(_io.read(spark, sf_dir, "documents"), default_ranks(), keep=["doc_id"], decoded=True)
    ids = F.col(_io.OWN + "ids")
    return out.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(_io.OWN + "decoded"), 256).alias("decoded_sha256"),
    )
