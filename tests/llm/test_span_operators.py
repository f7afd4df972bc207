"""Personal data and secrets against brute force over the plain patterns."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import pii, secret_scan
from corvane.llm._spans import joined

ODD = [None, "", " ", "\n", "é@é.com", "x" * 50000 + "@", "a.b@c.d.e_x@y.z", "1.2.3.4.5.6.7.8.256.1.1.1", "🙂 a@b.co 🙂 010.020.030.040", "1 " * 3000, "+1 (555) 123-4567.", "+12345678901234567", "a." * 4000, "a@" + "b." * 5000 + "c"]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii_base(t):
    out = []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(d := re.sub(r"\D", "", v)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub(r"\D", "", v)) <= 15),
    ]
    for o, (kind, p, ok) in enumerate(rules):
        out += [(m.start(), o, m.end(), kind) for m in re.finditer(p, t or "") if ok(m[0])]
    return sorted(out)


def secret_base(t):
    out = []
    rules = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    for o, (kind, p, ok) in enumerate(rules):
        out += [(m.start(), o, m.end(), kind) for m in re.finditer(p, t or "", re.ASCII) if ok(m)]
    return sorted(out)


def text(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 7}", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, start string")


def test_pii_base_equals_brute_force(spark):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", ".", "com", " ", "-", "1", "23", "456", "4539578763621486", "+1", "(", ")", "é", "192.168.0.1", "255", "_", "x@y.org", "+44 20 7946 0958", "\n", "🙂"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out = pii.personal_data(frame(spark, texts)).select("doc_id", joined(F.filter("__cv_spans", lambda x: x["base"])).alias("b")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.b == text(pii_base(texts[r.doc_id])), texts[r.doc_id]


def test_pii_adds_likely_spans_only(spark):
    texts = ["call me at (415) 555-2671 please", "write to nora.birch [at] maple [dot] org now", "part 123 456 789 of the order", "we met at river.Then stone", "host 2001:db8:1:2:3:4:5:6 up"]
    out = {r.doc_id: r.s for r in pii.personal_data(frame(spark, texts)).select("doc_id", joined(F.col("__cv_spans")).alias("s")).collect()}
    assert out[0] == "phone:11:25" and out[1].startswith("email:9:") and out[4].startswith("ip:5:")
    assert out[2] == "" and out[3] == ""
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_secret_base_equals_brute_force(spark):
    rng = random.Random(6)
    bits = ["token", "Secret", "API_KEY", "apikey", "password", " ", ":", "=", '"', "'", "abcdef", "0123456789abcdef", "AKIA", "QWERTYUIOP123456", "é", "-", "\n", "ſecret", "/", "🙂"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    out = secret_scan.secret_scan(frame(spark, texts)).select("doc_id", joined(F.filter("__cv_spans", lambda x: x["order"] < 3)).alias("b")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.b == text(secret_base(texts[r.doc_id])), texts[r.doc_id]


def test_secret_ownership(spark):
    shared, own = "ghp_" + "a1B2" * 9, "ghp_" + "Zz9y" * 9
    texts = [f"see {shared} here" for _ in range(20)] + [f"mine {own}", f"token = {'ab12' * 6}"]
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    assert [s.kind for s in rows[0]["__cv_spans"] if s.order > 2] == []
    assert "vendor" in [s.kind for s in rows[20]["__cv_spans"]]
    assert all(s.live for s in rows[21]["__cv_spans"]) and len(rows[21]["__cv_spans"]) == 2
    twice = secret_scan.secret_scan(docs.union(docs)).count()
    assert twice == 2 * len(texts) and secret_scan.secret_scan(frame(spark, [])).count() == 0
    with pytest.raises(Exception, match="source"):
        secret_scan.secret_scan(docs.drop("source")).count()
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
