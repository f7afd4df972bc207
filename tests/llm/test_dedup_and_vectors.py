"""Exact dedup, vector codes and centroid clusters against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm import _vectors as V
from corvane.llm import centroid_clusters as C
from corvane.llm import exact_dedup as X
from corvane.llm import vector_codes as K
from corvane.llm.registry import QUERIES

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    keep = {h: max((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    out = []
    for i, t in rows:
        h = hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
        out.append((i, keep[h], len(groups[h]), i == keep[h], h))
    return sorted(out, key=str)


def dedup(df, **more):
    return sorted(((r.doc_id, r["__cv_keep_id"], r["__cv_group_size"], r["__cv_kept"], r["__cv_sha256"].hex()) for r in X.exact_dedup(df, **more).collect()), key=str)


def test_dedup_of_nulls_ties_repeats_and_hot_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Same text", "same TEXT", "ÄÖ same", "äö same", "", None, "text\n", "text"]) if rng.random() < 0.5 else f"own {i}") for i in range(600)]
    rows += [(None, "same text"), (None, "nobody"), (None, "NOBODY"), (7, "twice"), (7, "Twice"), (9, "x" * 3_000_000), (8, "X" * 3_000_000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, __x string, kept int").repartition(7)
    want = brute_dedup(rows)
    assert dedup(df) == want
    assert dedup(df, keep=["doc_id"], most_bits=1024) == want  # five slices
    out = X.exact_dedup(df)
    assert out.columns[:4] == df.columns and {r.kept for r in out.select("kept").collect()} == {1}
    assert dedup(df.limit(0)) == []


def test_a_filter_never_loses_a_repeated_name():
    rng = np.random.default_rng(2)
    names = rng.integers(0, 2**56, 20_000)
    again = names[:3000]
    f = X.Filter(1 << 17)
    for part in np.array_split(np.concatenate([names, again]), 9):
        f.add(part)
    found = X.repeated(f.twice, names)
    assert found[:3000].all() and found[3000:].mean() < 0.2


def test_partial_filters_merge_to_the_whole(spark):
    rng = np.random.default_rng(3)
    names = np.concatenate([rng.integers(0, 2**56, 5000), rng.integers(0, 50, 500)])
    f = X.Filter(1 << 20)
    f.add(names)
    df = spark.createDataFrame([(int(x),) for x in names], "name long").repartition(5)
    twice = np.zeros((1 << 20) // 8, np.uint8)
    for r in X._merged(X._partial(df, 1 << 20)).collect():
        twice[r.segment * X.SEGMENT : r.segment * X.SEGMENT + len(r.twice)] = np.frombuffer(r.twice, np.uint8)
    assert (twice == f.twice).all()


def test_op11(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op11_exact_dedup"](spark, DIR).collect()), key=str)
    assert got == brute_dedup(rows)


# vector codes


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def brute_codes(rows, parts, entries, rounds, scale, width):
    """rows: (id, floats); ids are distinct."""
    kept = sorted((i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == parts * width and all(x is not None and math.isfinite(x) for x in v))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min(range(len(book)), key=lambda c: (square(x, book[c]), c))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v in kept:
                own[nearest(cut(v, p), books[p])].append(cut(v, p))
            books[p] = [[sum(col) // len(own[c]) for col in zip(*own[c], strict=True)] if c in own else e for c, e in enumerate(books[p])]
    out = {}
    for i, v in kept:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[i] = (code, sum(square(cut(v, p), books[p][c]) for p, c in enumerate(code)))
    return out, books


def vectors(rng, n, d):
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]
        rows.append((i * 3 - 20, rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.2 else v))  # copies, so ties
    return rows


def test_codes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = vectors(rng, 260, 8)
    odd = [(1000, None), (1001, [math.nan] * 8), (1002, [math.inf] + [0.0] * 7), (1003, [None] + [0.0] * 7), (1004, [1.0] * 4), (1005, []), (1006, [-0.001] * 8), (-1000, [1e30] * 8)]
    df = spark.createDataFrame([(*r, "a") for r in rows + odd], "vec_id long, embedding array<double>, code string").repartition(5)
    for scale in (16, 1 << 24):  # the larger one leaves the exact doubles
        out, books = K.vector_codes(df, parts=4, entries=30, rounds=4, scale=scale)
        want, want_books = brute_codes(rows + [odd[6]], 4, 30, 4, scale, 2)
        got = {r.vec_id: (list(r["__cv_code"]), r["__cv_error"]) for r in out.collect()}
        assert got == want and books.tolist() == want_books
    assert out.columns == ["vec_id", "code", "__cv_code", "__cv_error"]
    assert K.vector_codes(df.limit(0))[0].count() == 0 and K.vector_codes(df.filter("vec_id is null"))[0].count() == 0
    few, books = K.vector_codes(df.filter("vec_id < 40").filter("vec_id >= -20"), scale=16)
    assert books.shape[1] == few.count() == 20 and {r["__cv_error"] for r in few.collect()} == {0}


def test_bounds_save_scans_and_keep_ties():
    rng = np.random.default_rng(5)
    x = np.floor(100 * np.concatenate([rng.normal(c, 0.2, (300, 4)) for c in range(0, 40, 4)])).astype(np.int64)
    entries = x[::100].copy()
    entries[1] = entries[0]  # equal entries: the lower index wins, always by a scan
    book, code, upper, lower, looked = K.Codebook(entries), None, None, None, []
    for _ in range(5):
        code, upper, lower, n = K.assign(x, book, code, upper, lower)
        looked.append(n)
        d = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), code])).all()
        sums = np.stack([x[code == k].sum(0) for k in range(len(book.entries))])
        book = K.Codebook(V.floors(sums, np.bincount(code, minlength=len(book.entries)), book.entries), book.entries)
    assert looked[0] == len(x) and looked[-1] < len(x) / 2


def test_op12(spark):
    t = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    x = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64).reshape(4, 16) for i, v, _ in t}
    ids = sorted(x)
    books = np.stack([[x[i][p] for i in ids[:256]] for p in range(4)])
    every = np.stack([x[i] for i in ids])
    for k in range(5):
        d = np.stack([((every[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(4)], 1)
        code = d.argmin(2)
        if k < 4:
            books = np.stack([[every[code[:, p] == c, p].sum(0) // (code[:, p] == c).sum() if (code[:, p] == c).any() else books[p][c] for c in range(256)] for p in range(4)])
    error = {i: int(d[r].min(1).sum()) for r, i in enumerate(ids)}
    label = defaultdict(int)
    for i, _, k in t:
        label[k] += error[i]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = QUERIES["op12_vector_codes"](spark, DIR).collect()
    assert len(rows) == len(t) and {r.codebooks_sha256 for r in rows} == {digest}
    where, of = {i: r for r, i in enumerate(ids)}, {i: k for i, _, k in t}
    for r in rows:
        assert (r.code, r.error, r.label_error) == ("".join(f"{c:02x}" for c in code[where[r.vec_id]]), error[r.vec_id], label[of[r.vec_id]])


# centroid clusters


def brute_clusters(rows, k, rounds, scale, dims):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: hashlib.sha256(f"2:{x[0]}".encode()).hexdigest())
    centres = [v for _, v in order[:k]]
    nearest = lambda v: min(range(len(centres)), key=lambda c: (square(v, centres[c]), c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)].append(v)
        centres = [[sum(col) // len(own[c]) for col in zip(*own[c], strict=True)] if c in own else e for c, e in enumerate(centres)]
    return sorted(((i, nearest(v), square(v, centres[nearest(v)])) for i, v in kept), key=str), centres


def test_clusters_equal_brute_force(spark):
    rng = random.Random(6)
    rows = vectors(rng, 300, 8)
    odd = [(1000, None), (1001, [math.nan] * 8), (1002, [math.inf] + [0.0] * 7), (1003, [None] + [0.0] * 7), (1004, [1.0] * 4), (1005, []), (None, [0.5] * 8)]
    df = spark.createDataFrame([(*r, 5) for r in rows + odd], "vec_id long, embedding array<double>, cluster int").repartition(5)
    out, centres = C.centroid_clusters(df, k=12, rounds=5, scale=32, dims=8)
    want, want_centres = brute_clusters(rows + [odd[-1]], 12, 5, 32, 8)
    assert sorted(((r.vec_id, r["__cv_cluster"], r["__cv_distance"]) for r in out.collect()), key=str) == want and centres.tolist() == want_centres
    assert out.columns == ["vec_id", "cluster", "__cv_cluster", "__cv_distance"]
    assert C.centroid_clusters(df.limit(0))[0].count() == 0 and C.centroid_clusters(df, dims=8)[1].shape == (40, 8)


@pytest.mark.parametrize("spread", [1, 40])
def test_screening_is_exact_and_saves_distances(spread):
    rng = np.random.default_rng(7)
    x = rng.integers(-50, 50, (2000, 64)) + rng.integers(0, 8, (2000, 1)) * spread * np.repeat(rng.integers(0, 2, (1, 16)), 4, 1)
    centroids = x[:40].copy()
    centroids[3] = centroids[2]
    at, best, made = C.nearest(x, C.norms(x, 16), centroids)
    d = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
    assert made < d.size / (3 if spread > 1 else 1)


def test_op13(spark):
    t = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    want, centres = brute_clusters(t, 40, 5, 256, 64)
    sums = defaultdict(int)
    for _, c, d in want:
        sums[c] += d
    got = QUERIES["op13_centroid_clusters"](spark, DIR).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    for r in got:
        assert r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
