"""Vector code compression: product codes of whole-number vectors, trained by Lloyd's rounds with Hamerly's bounds.

A vector is cut into equal parts, and each part gets the index of the nearest entry of its position's codebook. Every part
keeps two numbers from round to round: an upper bound of the distance to its entry and a lower bound of the distance to
any other. When entries move, the upper bound grows by the move of the own entry and the lower one shrinks by the largest
move of another. If the upper bound is below the lower one, or below half the way from the own entry to its nearest
neighbour, both strictly, no other entry can be as near, and the part stays without a scan. Else the own distance is made
exact, and only if bounds still fail all entries are compared in whole numbers; the lower index wins ties. Bounds are doubles
that are widened by more than their rounding, so they only ever cost a scan.

A round is one pass: it reads the table of vectors, codes and bounds in the shared folder, writes the next one, and each task
adds rows with what left and what joined the sums of each entry, so sums follow the changes only. The driver holds codebooks
and sums, ``parts * entries`` short vectors.

Edge cases: vectors that are null or hold null or non-finite components are left out, and so are those of another number
of components than most kept vectors have (ties: the larger), or than ``parts`` divides, and those with a component that
scales to 2**27 or more, whose distances would not fit a long. Fewer than ``entries`` vectors make a smaller codebook. Vectors without an id
begin no entry; rows of one id stand in the order of their components. An empty table gives an empty result and empty codebooks. Extra
columns are kept and helper columns start with ``__cv_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io
from . import _vectors as V

#: Labels that may be broadcast.
MOST_BROADCAST = 200_000
#: What bounds are widened by, in parts of their size and absolutely.
SLACK, LEAST = 1e-9, 1e-6
_STATE = "v array<int>, code array<int>, upper array<double>, lower array<double>, error long, part int, entry int, count long, sums array<long>"


class Codebook:
    """The entries of one part position, how far each moved last, and half its way to the nearest other entry."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        n = len(entries)
        between = V.distances(entries, entries).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        self.half = np.sqrt(between.min(1, initial=np.inf)) / 2 * (1 - SLACK)
        moved = np.zeros(n) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        self.moved = moved
        top = np.sort(moved)[::-1]
        self.others = np.where(moved == top[0], top[1] if n > 1 else 0.0, top[0]) if n else moved


def assign(x: np.ndarray, book: Codebook, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, upper and lower bounds of parts ``x`` after a round, and how many were scanned; without bounds all are."""
    n = len(x)
    if code is None:
        code, upper, lower, look = np.zeros(n, np.int64), np.empty(n), np.empty(n), np.arange(n)
    else:
        upper, lower = upper + book.moved[code], lower - book.others[code]
        bar = np.maximum(lower, book.half[code])
        look = np.flatnonzero(~(upper < bar))
        d = x[look] - book.entries[code[look]]
        upper[look] = np.sqrt((d * d).sum(1).astype(np.float64)) * (1 + SLACK) + LEAST
        look = look[~(upper[look] < bar[look])]
        code = code.copy()
    if len(look):
        d = V.distances(x[look], book.entries)
        best = d.argmin(1)  # the first of equal ones
        row = np.arange(len(look))
        code[look], upper[look] = best, np.sqrt(d[row, best].astype(np.float64)) * (1 + SLACK) + LEAST
        d = d.astype(np.float64)
        d[row, best] = np.inf
        lower[look] = np.sqrt(d.min(1)) * (1 - SLACK) - LEAST
    return code, upper, lower, len(look)


class Changes:
    """What joins and leaves the sums of entries in one task."""

    def __init__(self, parts: int, entries: int, width: int):
        self.count, self.sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)

    def add(self, part: int, x: np.ndarray, code: np.ndarray, sign: int) -> None:
        if len(code):
            order = np.argsort(code, kind="stable")
            ranked = code[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            self.sums[part, ranked[first]] += sign * np.add.reduceat(x[order], first, axis=0)
            self.count[part, ranked[first]] += sign * np.diff(np.append(first, len(ranked)))

    def rows(self) -> tuple[np.ndarray, ...]:
        part, entry = np.nonzero((self.count != 0) | (self.sums != 0).any(2))
        return part, entry, self.count[part, entry], self.sums[part, entry]


def _round(table: DataFrame, carried: list[str], books: list[Codebook], scale: int | None, last: bool) -> DataFrame:
    """The next table: rows with code and bounds, and rows (part, entry, count, sums) of changes.

    ``scale`` says that ``v`` holds doubles that no round has seen.
    """
    parts, (entries, width) = len(books), books[0].entries.shape
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.select(*carried).schema] + T._parse_datatype_string(_STATE).fields)
    kept = [f.name for f in schema][: len(carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = Changes(parts, entries, width)
        kinds = None
        for batch in batches:
            kinds = [batch.column(c).type for c in range(len(kept))]
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(batch.schema.get_field_index("v"))
            x = V.matrix(v, parts * width)
            x = V.whole(x, scale) if scale else x.astype(np.int64)
            code, upper, lower, error = np.empty((n, parts), np.int64), np.empty((n, parts)), np.empty((n, parts)), np.zeros(n, np.int64)
            had = None if scale else [V.matrix(batch.column(batch.schema.get_field_index(c)), parts) for c in ("code", "upper", "lower")]
            for p, book in enumerate(books):
                own = x[:, p * width : (p + 1) * width]
                code[:, p], upper[:, p], lower[:, p], _ = assign(own, book, *((None,) * 3 if had is None else (had[0][:, p].astype(np.int64), had[1][:, p], had[2][:, p])))
                if last:
                    d = own - book.entries[code[:, p]]
                    error += (d * d).sum(1)
                else:
                    new = np.arange(n) if had is None else np.flatnonzero(had[0][:, p] != code[:, p])
                    changes.add(p, own[new], code[new, p], 1)
                    if had is not None:
                        changes.add(p, own[new], had[0][new, p].astype(np.int64), -1)
            empty = lambda kind: pa.nulls(n, kind)  # noqa: B023, E731
            state = [empty(pa.list_(pa.int32())), V.lists(code, pa.int32()), empty(pa.list_(pa.float64())), empty(pa.list_(pa.float64())), pa.array(error)] if last else [V.lists(x, pa.int32()), V.lists(code, pa.int32()), V.lists(upper, pa.float64()), V.lists(lower, pa.float64()), empty(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *state, empty(pa.int32()), empty(pa.int32()), empty(pa.int64()), empty(pa.list_(pa.int64()))], names=schema.names)
        part, entry, count, sums = changes.rows()
        if kinds is not None and len(part):
            empty = lambda kind: pa.nulls(len(part), kind)
            yield pa.RecordBatch.from_arrays([*map(empty, kinds), *(empty(pa.list_(k)) for k in (pa.int32(), pa.int32(), pa.float64(), pa.float64())), empty(pa.int64()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count), V.lists(sums, pa.int64())], names=schema.names)

    return table.mapInArrow(_io.lean(run), schema)


def vector_codes(df: DataFrame, vector: str = "embedding", id: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, keep: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """``keep`` (all columns but the vector if None) with ``__cv_code`` (indexes, one a part) and ``__cv_error``; the codebooks (part, entry, component)."""
    spark = df.sparkSession
    _io.bounded_batches(spark, rows=4096)
    names = [c for c in df.columns if c != vector] if keep is None else keep
    carried = [_io.OWN + f"k{i}" for i in range(len(names))]
    x = F.col(vector).cast("array<double>")
    usable = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, carried, strict=True)], F.col(id).alias(_io.OWN + "id"), x.alias("v")).filter(V.usable(F.col("v"), scale))
    sizes = usable.groupBy(F.size("v").alias("d")).count().filter((F.col("d") > 0) & (F.col("d") % parts == 0)).orderBy(F.desc("count"), F.desc("d")).first()
    width = (sizes.d if sizes else parts) // parts
    table = usable.filter(F.size("v") == width * parts)
    first = [r.v for r in table.filter(F.col(_io.OWN + "id").isNotNull()).orderBy(_io.OWN + "id", "v").select("v").limit(entries).collect()]
    start = V.whole(np.array(first, np.float64).reshape(len(first), width * parts), scale).reshape(len(first), parts, width).transpose(1, 0, 2)
    if not len(first):  # no vector with an id: nothing to begin from
        return df.select(*[f"`{c}`" for c in names], F.lit(None).cast("array<int>").alias(_io.OWN + "code"), F.lit(None).cast("long").alias(_io.OWN + "error")).filter(F.lit(False)), start
    books = [Codebook(b) for b in start]
    count, sums = np.zeros(start.shape[:2], np.int64), np.zeros(start.shape, np.int64)
    now, state = table.select(*carried, "v"), None
    for k in range(rounds + 1):
        last = k == rounds
        out = _round(now, carried, books, scale if k == 0 else None, last)
        before, state = state, _io.materialize(out)
        if before is not None:
            _io.discard(before)
        now = state.filter("part is null").select(*carried, "v", "code", "upper", "lower")
        if not last:
            for part, entry, n, x in V.summed(state.filter("part is not null").select("part", "entry", "count", "sums"), ("part", "entry")):
                count[part, entry] += n
                sums[part, entry] += np.array(x, np.int64)
            books = [Codebook(V.floors(sums[p], count[p], b.entries), b.entries) for p, b in enumerate(books)]
    out = state.filter("part is null")
    out = out.select(*[F.col(k).alias(c) for c, k in zip(names, carried, strict=True)], F.col("code").alias(_io.OWN + "code"), F.col("error").alias(_io.OWN + "error"))
    return out, np.stack([b.entries for b in books])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes(_io.read(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    error, label = F.col(_io.OWN + "error"), F.col("label")
    each = _io.materialize(out.groupBy(label.alias("l")).agg(F.sum(error).alias("label_error")))
    if each.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        each = F.broadcast(each)
    code = F.array_join(F.transform(_io.OWN + "code", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
    return out.join(each, label.eqNullSafe(F.col("l"))).select("vec_id", code.alias("code"), error.alias("error"), "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, dims: int = 64) -> str:
    width = dims // parts
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
x AS MATERIALIZED (SELECT vec_id, p, v[p * {width} + 1:(p + 1) * {width}] AS x FROM v, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS c, x AS y FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, x, min(d) AS m FROM
  (SELECT vec_id, p, x, CAST(list_sum(list_transform(range(1, {width + 1}), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS BIGINT) * {entries} + c AS d FROM x JOIN c{r} USING (p)) GROUP BY vec_id, p, x)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT p, c, coalesce(s.y, c{r}.y) AS y FROM c{r} LEFT JOIN
  (SELECT p, c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS y FROM (SELECT p, m % {entries} AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {width + 1}) t(i) GROUP BY ALL) GROUP BY p, c) s USING (p, c))""")
    return "WITH " + ",\n".join(steps) + f""",
e AS (SELECT vec_id, string_agg(lower(printf('%02x', m % {entries})), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h
"""


ORACLE = _oracle()
