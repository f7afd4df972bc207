"""Quality rules, decontamination and byte-level BPE against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from corvane.llm import _io, byte_bpe, decontaminate
from corvane.llm import _words as W
from corvane.llm import jaccard_join as J
from corvane.llm._stats import block_stats
from corvane.llm.quality_rules import LabelModel, fit, quality_rules, rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, __x int"
ODD = [None, "", " ", "\n", "a", "a a a a", "a b c a b c", "x\n\nx\n \ny\nx", "l1 w\nl1 w\nl1 w", "é " * 60, "#a $b %c", "\x0b\x0c\r\t", "ß ß 　x", "word " * 3000, "A!! B!! " * 40, "0", "z" * 70000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "clash", None, 1) for i, t in enumerate(texts)], DOCS)


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_rules_base(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab \n\t#é") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    out = quality_rules(frame(spark, texts))
    assert [c for c in out.columns if not c.startswith("__cv_")] == frame(spark, []).columns
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = base(texts[r.doc_id])
        assert (r["__cv_n_words"], r["__cv_word_chars"], r["__cv_n_symbols"], r["__cv_n_dup_lines"], r["__cv_n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["__cv_base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["__cv_base_failed"] and r["__cv_kept"])


def test_quality_rules_empty_table(spark):
    assert quality_rules(frame(spark, [])).count() == 0


def posterior(model, patterns):
    """P(good | votes) by Bayes' rule over the classes."""
    out = []
    for p in patterns:
        like = [share * np.prod([1 if v == 0 else q if v < 0 else 1 - q for v, q in zip(p, rejects, strict=True)]) for share, rejects in zip(model.share, model.rejects, strict=True)]
        out.append(sum(x for x, g in zip(like, model.good, strict=True) if g) / sum(like))
    return np.array(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_label_model_recovers_planted_rates(seed):
    """Two kinds of defects, false alarms and abstentions: shares and rates within 0.02, accuracies within 0.02."""
    rng = np.random.default_rng(seed)
    n, rules = 40000, 9
    kind = rng.choice(3, n, p=[0.7, 0.2, 0.1])
    rate = np.tile(rng.uniform(0.01, 0.08, rules), (3, 1))
    rate[1, :3], rate[2, 3:6] = [0.8, 0.7, 0.9], [0.75, 0.9, 0.6]
    votes = np.where(rng.random((n, rules)) < rate[kind], -1, 1)
    votes[rng.random((n, rules)) < 0.2] = 0
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = fit(patterns.astype(float), counts.astype(float), list("abcdefghi"))
    assert sorted(model.good) == [False, False, True]
    assert abs(model.prior - 0.7) < 0.02
    assert np.abs(model.rates(True) - rate[0]).max() < 0.02
    assert np.abs(model.rates(False) - (2 * rate[1] + rate[2]) / 3).max() < 0.02
    right = (kind[:, None] == 0) == (votes > 0)
    assert np.abs(model.accuracies() - (right & (votes != 0)).sum(0) / (votes != 0).sum(0)).max() < 0.02
    said = posterior(model, patterns)[at.ravel()] >= 0.5
    best = LabelModel(list("abcdefghi"), np.array([0.7, 0.2, 0.1]), rate, np.array([True, False, False]))
    assert (said == (kind == 0)).mean() > ((posterior(best, patterns)[at.ravel()] >= 0.5) == (kind == 0)).mean() - 0.005


def test_no_estimate_lies_on_a_bound():
    rng = np.random.default_rng(3)
    votes = np.where(rng.random((5000, 4)) < np.where(rng.random(5000) < 0.6, 0.05, 0.7)[:, None], -1, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = fit(patterns.astype(float), counts.astype(float), list("abcd"))
    assert ((model.rejects > 0) & (model.rejects < 1)).all() and abs(model.share.sum() - 1) < 1e-9
    assert np.abs(model.rates(True) - 0.05).max() < 0.03 and np.abs(model.rates(False) - 0.7).max() < 0.03


def test_two_kinds_of_bad_texts_are_both_found():
    good, first, second = [1] * 6, [-1, -1, 1, 1, 1, 1], [1, 1, 1, -1, -1, 1]
    for n in ((900, 60, 10), (900, 10, 60), (80, 8, 8), (10**9, 10**7, 10**8)):
        patterns = np.array([good, first, second], float)
        got = posterior(fit(patterns, np.array(n, float), list("abcdef")), patterns)
        assert got[0] > 0.5 > max(got[1:])


def test_posterior_column_and_verdict_follow_bayes(spark):
    """The verdict of each row of the query, from the votes in the table and the model of their counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = quality_rules(docs.unionByName(docs.limit(20))).collect()
    votes = [c for c in rows[0].asDict() if c.startswith("__cv_v_")]
    seen = Counter(tuple(r[c] for c in votes) for r in rows)
    patterns = np.array(sorted(seen), float)
    said = dict(zip(sorted(seen), posterior(fit(patterns, np.array([seen[p] for p in sorted(seen)], float), list(rules())), patterns), strict=True))
    for r in rows:
        p = said[tuple(r[c] for c in votes)]
        assert abs(r["__cv_posterior"] - p) < 1e-6
        assert r["__cv_kept"] == (not r["__cv_base_failed"] and p >= 0.5)
    twice = {}
    for r in rows:  # repeated rows get equal results
        assert twice.setdefault(r.doc_id, r["__cv_posterior"]) == r["__cv_posterior"]


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 128, 1024, 2048, 4096, 8192])
def test_words_of_a_regular_structure_have_names_of_their_own(spark, n):
    a, b = thue_morse(n)
    data = np.frombuffer(f"{a}\n{b}".encode(), np.uint8)
    assert len(set(W.hashes(data, np.array([0, n + 1]), np.array([n, 2 * n + 1])).tolist())) == 2
    got = block_stats(data, np.array([0, len(data)]))
    assert got["n_dup_lines"][0] == 0 and got["n_distinct_words"][0] == 2
    blocks = np.frombuffer((a + b).encode(), np.uint8)
    sets = list(J.text_sets(blocks, np.array([0, n, 2 * n]), 3))
    assert J.set_name(sets[0]) != J.set_name(sets[1])


def test_hashes_depend_on_the_span_alone():
    rng = random.Random(8)
    spans = ["".join(rng.choice("ab\0é") for _ in range(rng.choice([0, 1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))).encode() for _ in range(400)]
    seen = {}
    for order in (spans, spans[::-1]):
        data = np.frombuffer(b"x".join(order) + b"y", np.uint8)
        ends = np.cumsum([len(s) + 1 for s in order]) - 1
        for s, h in zip(order, W.hashes(data, ends - [len(s) for s in order], ends).tolist(), strict=True):
            assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


def words9(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def brute9(text, bench):
    w = words9(text)
    hit, found = set(), set()
    for item, t in bench:
        v = words9(t)
        m = min(13, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1) if m else ():
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [16 << 20, 60])
def test_decontaminate_equals_brute_force(spark, block_bytes):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "The", "é", "x1", "of"])
    bench = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 20])))) for i in range(12)] + [(3, "a b"), (50, None), (51, "The  OF, the of the of the of the of the of the of x1")]
    texts = ODD + [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"q z {rng.choice(bench)[1]} z, q" for _ in range(40)] + ["the of " * 900]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, texts), table, block_bytes=block_bytes).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["__cv_n_words"], r["__cv_n_hit"], r["__cv_items"]) == brute9(texts[r.doc_id], bench), texts[r.doc_id]


def test_decontaminate_with_string_ids_and_repeated_documents(spark):
    items = [(f"q{i}", t) for i, t in enumerate(["one two three four five six seven eight nine ten eleven twelve thirteen", "short one", "", None])] + [(None, "lost words"), ("q0", "again here")]
    table = spark.createDataFrame(items, "item_id string, text string")
    texts = ["a short one b", "a short one b", " ".join(f"x{i}" for i in range(20)) + " one two three four five six seven eight nine ten eleven twelve thirteen", "lost words", "again here"]
    for block_bytes in (8 << 20, 10):
        got = {r.doc_id: (r["__cv_n_words"], r["__cv_n_hit"], r["__cv_items"]) for r in decontaminate.decontaminate(frame(spark, texts), table, block_bytes=block_bytes).collect()}
        assert got == {0: (4, 2, ["q1"]), 1: (4, 2, ["q1"]), 2: (33, 13, ["q0"]), 3: (2, 0, []), 4: (2, 2, ["q0"])}


def test_equal_hashes_of_windows_stay_apart(monkeypatch):
    """Test strings are told apart by their words even where their hashes agree."""
    monkeypatch.setattr(decontaminate, "_named", lambda words: np.zeros(len(words[0]), np.uint64))
    ids, patterns = decontaminate.build([(1, "a b c"), (2, "x b c"), (3, "a b c"), (4, "b c")])
    data = np.frombuffer(b"a b c, q b c", np.uint8)
    first, hit, items = decontaminate.scan_block(ids, patterns, data, np.array([0, 5, 12]))
    assert items == [{1, 3, 4}, {4}] and hit.tolist() == [True] * 3 + [False, True, True] and first.tolist() == [0, 3, 6]


def test_decontaminate_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, []), none).count() == 0
    assert {r["__cv_n_hit"] for r in decontaminate.decontaminate(frame(spark, ODD), none).collect()} == {0}


def plain():
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.default_ranks(), special_tokens={})


def test_bpe_equals_the_library(spark):
    enc = plain()
    rng = random.Random(3)
    alphabet = ["a", "B", "the", "'", "'s", "'ll", "'re", "'v", "l", " ", "  ", "\n", "\t", " ", "1", "²", "é", "漢字", "🙂", "!", "--", "　", "<|endoftext|>", "ing", "́", "\r\n"]
    texts = ODD[:-1] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    df = byte_bpe.encode(frame(spark, texts), byte_bpe.default_ranks(), decoded=True)
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert list(r["__cv_ids"]) == enc.encode_ordinary(t), repr(t)
        assert bytes(r["__cv_decoded"]) == t.encode()
    back = byte_bpe.decode(df.select("doc_id", "__cv_ids"), byte_bpe.default_ranks()).collect()
    assert all(bytes(r["__cv_decoded"]) == (texts[r.doc_id] or "").encode() for r in back)


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    h = byte_bpe.PerfectHash(keys)
    assert (h.find(keys) == np.arange(5000)).all()
    assert sorted(h.slots.tolist()) == list(range(5000))
    assert (h.find(keys + np.uint64(1)) == -1).all()


def test_bpe_recovers_from_equal_hashes():
    ranks = byte_bpe.default_ranks()
    coder = byte_bpe.Coder(ranks, byte_bpe.PerfectHash(byte_bpe._hash_all(list(ranks))))
    text = b"zqzq hello"
    data = np.frombuffer(text, np.uint8)
    coder.encode(data, np.array([0, len(data)]))
    coder.pool = coder.pool[::-1].copy()
    ids, first, decoded = coder.round_trip(data, np.array([0, len(data)]))
    assert decoded == [text] and ids.tolist() == coder.slow(text)
    assert base64.b64encode(decoded[0]) and hashlib.sha256(decoded[0]).hexdigest() and _io.OWN
