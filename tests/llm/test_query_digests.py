"""Every column that the contract fixes for the queries, and the spans that the methods add, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_jaccard_join import brute as brute_components
from test_span_operators import frame, pii_base, secret_base, text
from test_text_operators import base, brute9

from corvane.llm import byte_bpe, pii, secret_scan
from corvane.llm._spans import without_overlaps
from corvane.llm.registry import QUERIES

DIR = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def rows_of(spark, name):
    rows = QUERIES[name](spark, DIR).collect()
    return {r.doc_id: r for r in rows}, len(rows)


def test_op1(spark, docs):
    got, n = rows_of(spark, "op1_quality_rules")
    assert n == len(docs) and got.keys() == docs.keys()
    for d, r in got.items():
        want = base(docs[d].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_op2(spark, docs):
    got, n = rows_of(spark, "op2_jaccard_join")
    ids = sorted(docs)
    assert n == len(docs)
    for d, (_, size, root) in zip(ids, brute_components([docs[d].text for d in ids], 3, 90), strict=True):
        assert (got[d].n_shingles, got[d].component_id) == (size, ids[root])


def test_op4(spark, docs):
    got, n = rows_of(spark, "op4_quality_classifier")
    assert n == len(docs)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op8(spark, docs):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.default_ranks(), special_tokens={})
    got, n = rows_of(spark, "op8_byte_bpe")
    assert n == len(docs)
    for d, r in got.items():
        ids = enc.encode_ordinary(docs[d].text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(docs[d].text or ""))


def test_op9(spark, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    windows = defaultdict(set)  # as brute9, but each item's windows once
    from test_text_operators import words9

    for item, t in bench:
        v = words9(t)
        m = min(13, len(v))
        for i in range(len(v) - m + 1) if m else ():
            windows[tuple(v[i : i + m])].add(item)
    sizes = {len(w) for w in windows}
    got, n = rows_of(spark, "op9_decontaminate")
    assert n == len(docs)
    for d, r in got.items():
        w, hit, items = words9(docs[d].text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if own := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    items |= own
        names = ",".join(sorted(map(str, items)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(items), sha(names))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    some = next(d for d, r in got.items() if r.n_hit)
    assert brute9(docs[some].text, bench)[:2] == (got[some].n_words, got[some].n_hit)


def features(t, kind, a, b):
    """What the trees read of a candidate, in plain Python."""
    v, before, after = t[a:b], t[max(0, a - pii.REACH) : a], t[b : b + pii.REACH]
    d = re.sub("[^0-9]", "", v)
    groups = [len(x) for x in re.findall("[0-9]+", v)] or [0]
    total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
    found = lambda p, s: float(bool(re.search(p, s)))
    return [
        pii.KINDS.index(kind), len(d), len(v), len(re.sub("[A-Za-z0-9]", "", v)), float(total % 10 == 0), len(set(d)) or 1, len(re.sub("[^A-Za-z]", "", v)), found(r"[\[(]", v),
        *[found(p, before) for p in pii._CONTEXT.values()],
        found(r"[0-9][\x20.,:-]?\Z", before), found(r"^[\x20.,:-]?[0-9]", after),
        found(pii.TOP.replace("$", r"\Z"), v), found(r"^\(?0", v), len(re.findall("[0-9]+", v)), max(groups), min(groups), v.count(":"), found(r"\x20@|@\x20|\bAT\b|\bDOT\b", v), found(r"^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})+\Z", v),
    ]


def brute7(t, model):
    start, trees, least = model
    own = pii_base(t)
    out = set(own)
    for order, kind in enumerate(pii.KINDS):
        for m in (m for name in pii.GENERATORS[kind] for m in re.finditer(pii.WIDER[name], t)):
            if any(s < m.end() and m.start() < e for s, _, e, _ in own):
                continue
            x = np.array([features(t, kind, m.start(), m.end())], float)
            if 1 / (1 + np.exp(-(start + sum(tree.predict(x)[0] for tree in trees)))) >= least[kind]:
                out.add((m.start(), order, m.end(), kind))
    return text(own), text(sorted(out))


def test_op7(spark, docs):
    got, n = rows_of(spark, "op7_pii")
    model = pii.model(spark)
    assert n == len(docs)
    for d, r in got.items():
        own, all_ = brute7(docs[d].text or "", model)
        kinds = Counter(s.split(":")[0] for s in own.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) == (kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], sha(own), all_)


def test_op7_added_spans_of_planted_phrases(spark, docs):
    """Phrases of another seed set into the words of real documents: recall and precision of the added spans, without base spans."""
    rng, texts, plants = random.Random(11), [], []
    words = [w for d in sorted(docs) for w in (docs[d].text or "").split() if w.isalpha()][:40000]
    for phrase, kind, good in pii.examples(1200, seed=12):
        i = rng.randrange(len(words) - 60)
        before = " ".join(words[i : i + 30])
        texts.append(f"{before} {phrase} {' '.join(words[i + 30 : i + 60])}")
        plants.append((kind, good, len(before) + 1, len(before) + 1 + len(phrase)))
    hits = Counter()
    model = pii.model(spark)
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, texts)).collect()}
    for i, (kind, good, a, b) in enumerate(plants):
        spans = [(s.kind, s.start, s.end) for s in got[i]["__cv_spans"]]
        assert ",".join(f"{k}:{s}:{e}" for k, s, e in spans) == brute7(texts[i], model)[1]
        added = [s for s in got[i]["__cv_spans"] if not s.base]
        hits[good, any(s.kind == kind and a <= s.start and s.end <= b for s in added)] += 1
        hits["elsewhere"] += any(not (a <= s.start and s.end <= b) for s in added)
    recall = hits[1, True] / (hits[1, True] + hits[1, False])
    precision = hits[1, True] / (hits[1, True] + hits[0, True])
    print(f"recall {recall:.3f}, precision {precision:.3f}, added elsewhere {hits['elsewhere']}")
    assert recall > 0.85 and precision > 0.97 and hits["elsewhere"] <= 3


def test_long_texts_take_linear_time(spark):
    texts = ["1" * 1_000_000, "1." * 300_000, "12 " * 300_000, "1.2.3." + "4" * 300_000, "+1" * 200_000, "(415) 555-2671, 1.1.1.1 " * 10_000]
    began = time.perf_counter()
    rows = {r.doc_id: r["__cv_spans"] for r in pii.personal_data(frame(spark, texts)).collect()}
    assert len(rows) == len(texts) and len(rows[1]) == 75_000 and rows[0] == [] and sum(s.kind == "ip" for s in rows[5]) == 10_000
    assert time.perf_counter() - began < 60


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for i in range(120):
        at, spans = 0, []
        for _ in range(rng.choice([0, 1, 5, 200])):
            at += rng.randint(0, 6)
            spans.append((at, at := at + rng.randint(1, 5)))
        others = [(a, a + rng.randint(1, 30)) for a in (rng.randint(0, 900) for _ in range(rng.choice([0, 1, 3, 150])))]
        rows.append((i, spans, others))
    place = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    df = spark.createDataFrame([(i, [(a, b, "v", "", "") for a, b in s], [(a, b) for a, b in o]) for i, s, o in rows], f"i int, s {place}, o array<struct<start:int,end:int>>")
    got = {r.i: [(x.start, x.end) for x in r.free] for r in without_overlaps(df, {"free": "s"}, "o").collect()}
    for i, spans, others in rows:
        assert got[i] == [(a, b) for a, b in spans if not any(x < b and a < y for x, y in others)]


def brute10(rows):
    """Base and added spans of (doc_id, owner, text) rows: (start, order, end, kind) and the values' distinct texts and owners."""
    found, texts, owners = {}, defaultdict(set), defaultdict(set)
    for d, owner, t in rows:
        t = t or ""
        out = []
        for order, kind in enumerate(secret_scan.KINDS):
            if kind in secret_scan.BASE:
                out += [(s, order, e, k, None) for s, _, e, k in secret_base(t) if k == kind]
                continue
            for m in re.finditer(secret_scan.WIDER[kind], t, re.ASCII):
                v = m[0]
                if kind == "dense" and not (re.search("[A-Z]", v) and re.search("[a-z]", v) and re.search("[0-9].*[0-9].*[0-9]", v) and len(set(v)) >= 14):
                    continue
                name = v if kind != "keyblock" else None if re.fullmatch(secret_scan._HEADER, v) else re.sub(r"\s|\\[nr]", "", v)
                out.append((m.start(), order, m.end(), kind, name))
        found[d] = out
        for s, order, e, k, name in out:
            if k in secret_scan.BASE:
                name = (re.match(secret_scan._ASSIGN, t[s:e])[2]) if k == "assign" else t[s:e]
            if name is not None:
                texts[name].add(t)
                owners[name].add(owner or "")
    live = lambda v: v is None or len(owners[v]) == 1 or (len(owners[v]) <= secret_scan.MOST_OWNERS and len(texts[v]) <= secret_scan.MOST_DOCUMENTS)
    return {d: text(sorted(s[:4] for s in out if s[3] in secret_scan.BASE or live(s[4]))) for d, out in found.items()}


def test_op10(spark, docs):
    got, n = rows_of(spark, "op10_secret_scan")
    assert n == len(docs)
    want = brute10([(d, r.source, r.text) for d, r in docs.items()])
    for d, r in got.items():
        own = text(secret_base(docs[d].text))
        kinds = Counter(s.split(":")[0] for s in own.split(",") if s)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == (kinds["assign"], kinds["access"], kinds["hex"], sha(own), want[d])


def test_secret_ownership_equals_brute_force(spark):
    rng = random.Random(13)
    pool = ["".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(40)) for _ in range(12)]
    pool += ["ghp_" + "".join(rng.choice("ABCabc0123456789") for _ in range(36)) for _ in range(8)]
    texts = []
    for i in range(400):
        v = pool[min(int(rng.expovariate(0.25)), len(pool) - 1)]
        texts.append(f"note {rng.randrange(1 if i % 3 else 60)} uses {v} here")
    rows = [(i, None if i % 50 == 0 else f"s{rng.randrange(1 + i % 9)}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i if i % 40 else None, t, o, "clash", i) for i, o, t in rows], "doc_id long, text string, source string, hash string, owner int")
    want = brute10(rows)
    got = secret_scan.secret_scan(df).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "source", "hash", "owner", "__cv_spans"}
    for r in got:
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r["__cv_spans"]) == want[r.owner]


def test_mirrors_of_one_text_are_one_document(spark):
    token = "ghp_" + "Zz9y" * 9
    rows = [(f"mine {token}", f"s{i % 2}") for i in range(120)] + [(f"note {i} {token[::-1]}ghp_{'Qq1' * 12}", f"s{i % 2}") for i in range(120)]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: [s.kind for s in r["__cv_spans"] if s.live and s.kind == "vendor"] for r in secret_scan.secret_scan(df).collect()}
    assert all(got[i] == ["vendor"] for i in range(120)) and all(got[i] == [] for i in range(120, 240))
