"""The Jaccard join and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from corvane.llm import jaccard_join as J
from corvane.llm.components import connected_components


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        m = min(k, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("xyz")
    texts = [None, "", " \n", "one", "ONE", "one two", "é a b", "a a a a a"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 10, 20, 25, 60, 150, 400]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                i = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[i] = word()
                elif rng.random() < 0.5:
                    del copy[i]
                else:
                    copy.insert(i, word())
                if not copy:
                    copy = ["z"]
            texts.append("  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    base = [word() for _ in range(100)]
    for _ in range(300):  # one large group about the threshold
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(100)] = word()
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 64)
    texts = corpus(k)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(5)
    got = sorted(map(tuple, J.jaccard_components(docs, k, percent).collect()))
    assert got == brute(texts, k, percent)


def test_rows_without_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (3, t + " more"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, J.jaccard_components(docs, 3, 90).collect()), key=str)
    assert got == sorted([(None, 78, None), (5, 78, 3), (5, 78, 3), (3, 79, 3), (9, 0, 9)], key=str)
    assert J.jaccard_components(docs.limit(0), 3, 90).count() == 0
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (6, a + " more"), (7, "more " + b), (8, b), (4, "else")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.jaccard_components(docs, 3, 90).collect()) == [(4, 4), (5, 5), (5, 5), (6, 5), (7, 5), (8, 5)]


def test_members_that_no_representative_links_are_found(spark, monkeypatch):
    """A chain of copies, each linked with its neighbours alone, beside a hub of near copies."""
    monkeypatch.setattr(J, "CHUNK", 8)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(40):  # neighbours differ in two words, ends in many
        words[(i * 7) % 200], words[(i * 11 + 3) % 200] = f"x{i}", f"y{i}"
        texts.append(" ".join(words))
    hub = [f"h{i}" for i in range(200)]
    for i in range(60):
        texts.append(" ".join(hub[:i] + [f"z{i}"] + hub[i + 1 :]))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, J.jaccard_components(docs, 3, 90).collect())) == brute(texts, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_always_meet(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        most = int(J.largest_difference(2 * len(a), percent))
        drop = int(rng.integers(0, most + 1))
        b = np.unique(np.concatenate([a[drop // 2 :], rng.integers(0, 1 << 64, drop - drop // 2, dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared) and J.set_name(a) != J.set_name(b):
            bands = J.Bands(percent)
            x, y = ({int(s) for g in bands.offers(v) for s in g} for v in (a, b))
            assert x & y


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (1, 2), (2, 3), (3, 1), (200, i := 300)] + [(500, j) for j in range(501, 580)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(None, 4)]
    up = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in up)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0 and i == 300


def test_all_close_partners_of_a_set_are_tried(spark):
    """A set whose nearest partner by sketches shares too few words, while buckets of two hold its link with another one."""
    words = [f"w{i}" for i in range(40000)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, words)])
    alike = {}
    for w, s in zip(words, J.text_sets(data, offsets, 1), strict=True):
        alike.setdefault(int(s[0]) % J.SKETCH_BITS, []).append(w)
    texts = []
    rng = np.random.default_rng(5)
    for _ in range(200):
        bits = rng.permutation(J.SKETCH_BITS)[:40].tolist()
        own, other = [alike[b].pop() for b in bits], [alike[b].pop() for b in bits[:14]]  # words whose sketches are equal
        texts += [" ".join(other + own[14:]), " ".join(own[4:] + [alike[b].pop() for b in bits[20:24]]), " ".join(own)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in J.jaccard_components(docs, 1, 80).collect())
    want = [row for g in range(0, len(texts), 3) for row in ((g + i, n, g + root) for i, n, root in brute(texts[g : g + 3], 1, 80))]
    assert got == want
