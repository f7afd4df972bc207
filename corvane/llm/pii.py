"""Personal data by candidate gradient boosting.

Base rules find e-mail and IP addresses, payment cards and phone numbers. High-recall generators propose further, overlapping
spans of the same kinds (addresses spelt out or spaced, IPv6 in full and shortened, all issuers' groupings of cards, national
plans of phone numbers; several generators a kind may propose spans that overlap); boosted trees read
format and context of each candidate, and a threshold a kind, calibrated for precision on held-out examples, selects the
spans that are added. A candidate that overlaps a base span is not added.

The trees are fitted on examples made here from phrase templates with a fixed seed (the tables bring no labels for personal
data), once a session; the same Spark columns make the features for fitting and for scoring, and the trees become one
column expression. Only DataFrame functions touch the documents; one pass, no shuffle.

Edge cases: null and empty texts have no spans; a match that fails its base rule (a part over 255, a wrong check digit, too
few or too many digits) is dropped and not retried; equal starts are ordered by kind; repeated rows give equal rows;
an empty table gives an empty result; extra columns are kept and helper columns start with ``__cv_``.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from ._spans import REACH, add_matches, joined, without_overlaps
from ._trees import boost

KINDS = ("email", "ip", "card", "phone")

_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    # equal to LOCAL+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, but reading each run of local characters once
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # equal to [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), but reading each run of digits once as the first of a match
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SEP = r"[\x20\u00A0._/\u2013-]"
_AT, _DOT = r"(?:\x20(?i:at)\x20|\x20?[\[({<]\x20?(?i:at)\x20?[\])}>]\x20?)", r"(?:\x20(?i:dot)\x20|\x20?[\[({<]\x20?(?i:dot)\x20?[\])}>]\x20?|\x20\.\x20|\.)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_PLANS = "|".join([
    rf"(?:00[0-9]{{2,3}}{_SEP})?[0-9]{{1,2}}(?:{_SEP}[0-9]{{2}}){{4}}(?![0-9])",  # pairs
    rf"(?:(?:00[0-9]{{2}}|1){_SEP})?\(?[0-9]{{2,5}}\)?{_SEP}[0-9]{{2,3}}{_SEP}(?:[0-9]{{2}}{_SEP}[0-9]{{2}}|[0-9]{{3,4}})(?![0-9])",  # long areas, groups of two and three
    rf"(?:00[0-9]{{2}}\x20)?\(?0[0-9]{{1,5}}\)?(?:{_SEP}|\x20/\x20)[0-9]{{5,8}}(?:-[0-9]{{1,4}})?(?![0-9])",  # area, and the subscriber at once
    r"[0-9]{10,11}(?![0-9A-Za-z])",  # all at once
])
#: High-recall generators, each named after its kind: several may propose spans at one place.
WIDER = {
    # spelt out in words or brackets of either case; and with spaces round the sign, whatever follows it
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,6}}+",
    "email_spaced": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20{{0,2}}@\x20{{0,2}}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{0,6}}+",
    # IPv6 in full, or shortened by "::", with a zone or an IPv4 address at its end
    "ip": rf"(?<![0-9A-Fa-f:])(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Fa-f:])|(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{{3}})(?:{_HEX}(?::{_HEX}){{0,6}}+)?+::(?:{_HEX}(?::{_HEX}){{0,6}}+)?+(?:(?:\.[0-9]{{1,3}}){{3}})?+(?:%[A-Za-z0-9]{{1,15}}+)?+(?![0-9A-Za-z:])",
    # the groupings of issuers (4-4-4 and a rest, 4-6-5, 4-6-4, 4-5-6), or 13 digits at once
    "card": rf"(?<![0-9])[0-9]{{4}}{_SEP}{{1,2}}(?:(?:[0-9]{{4}}{_SEP}{{1,2}}){{2}}[0-9]{{1,7}}|[0-9]{{6}}{_SEP}{{1,2}}[0-9]{{4,5}}|[0-9]{{5}}{_SEP}{{1,2}}[0-9]{{6}})(?![0-9])|(?<![0-9])[0-9]{{13}}(?![0-9])",
    # area and two groups; and national plans
    "phone": r"(?<![0-9+(.-])(?:00[0-9]{1,3}[\x20.-])?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "phone_plans": rf"(?<![0-9A-Za-z+(.,/-])(?:{_PLANS})",
}
GENERATORS = {k: [n for n in WIDER if n.split("_")[0] == k] for k in KINDS}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CONTEXT = {
    "email": r"(?i:e-?mail|contact|write|reach|kontakt|correo|courriel|address|send|ask)",
    "ip": r"(?i:\bip\b|ipv6|host|server|addr|login|client|peer|from|ping)",
    "card": r"(?i:card|visa|master|amex|pay|karte|carte|tarjeta)",
    "phone": r"(?i:phone|call|tel|fax|mobile|cell|dial|whatsapp|ring|text me|number is|sms|desk)",
    "other": r"(?i:order|invoice|version|isbn|serial|part|page|ref|ticket|model|no\.|#|lot|date)",
}
_FEATURES = ("kind", "digits", "size", "marks", "luhn", "distinct", "letters", "brackets", *[f"ctx_{k}" for k in _CONTEXT], "before_digit", "after_digit", "valid_code", "zero", "groups", "longest", "shortest", "colons", "upper_or_space", "pairs_only")
#: Ends of a host with a top-level name, plain or spelt out.
TOP = r"(?i:(?:\.|\x20\.\x20)(?:com|org|net|edu|gov|io|info|eu|ch|de|fr|es|it|nl|uk)$|(?:\bdot\b|\bdot\x20?[\])}>])\x20?[a-z]{2,4}$)"
_models: dict[str, tuple] = {}


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v`` pass the Luhn check."""
    d = F.reverse(digits_of(v))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.coalesce(F.substring(d, i, 1).try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def base_ok(kind: str, v: Column) -> Column:
    n = F.length(digits_of(v))
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & luhn(v)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _features(kind: str, s: Column) -> Column:
    v, before, after = s["value"], s["before"], s["after"]
    d = digits_of(v)
    n = lambda c: F.length(c).cast("double")
    groups = F.transform(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x).cast("double"))
    context = [_flag(before.rlike(p)) for p in _CONTEXT.values()]
    return F.array(
        F.lit(float(KINDS.index(kind))), n(d), n(v), n(F.regexp_replace(v, "[A-Za-z0-9]", "")), _flag(luhn(v)), F.size(F.array_distinct(F.split(d, ""))).cast("double"),
        n(F.regexp_replace(v, "[^A-Za-z]", "")), _flag(v.rlike(r"[\[(]")), *context,
        _flag(before.rlike(r"[0-9][\x20.,:-]?$")), _flag(after.rlike(r"^[\x20.,:-]?[0-9]")),
        _flag(v.rlike(TOP)), _flag(v.rlike(r"^\(?0")), F.size(groups).cast("double"), F.coalesce(F.array_max(groups), F.lit(0.0)), F.coalesce(F.array_min(groups), F.lit(0.0)),
        n(F.regexp_replace(v, "[^:]", "")), _flag(v.rlike(r"\x20@|@\x20|\bAT\b|\bDOT\b")), _flag(v.rlike("^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})+$")),
    )


def candidates(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__cv_m_<kind>`` (base spans that pass) and ``__cv_c_<kind>``: wider candidates as (start, end, x)."""
    t = F.col(text)
    many = t.rlike("[0-9]")
    only = {"email": t.contains("@"), "ip": many, "card": many, "phone": t.contains("+")}
    at = F.lower(t)
    only |= {"w_email": (at.contains("at ") | at.contains("at]") | at.contains("at)") | at.contains("at}") | at.contains("at>")), "w_email_spaced": t.contains("@"), "w_ip": t.contains(":")}
    only |= {f"w_{n}": many for k in ("card", "phone") for n in GENERATORS[k]}
    df = add_matches(df, text, {**BASE, **{f"w_{k}": p for k, p in WIDER.items()}}, only)
    base = {k: f"{_io.OWN}m_{k}" for k in KINDS}

    def passing(k: str) -> Column:
        return F.filter(base[k], lambda s: base_ok(k, s["value"]))

    def free(k: str) -> Column:
        made = lambda n: F.transform(F.col(f"{_io.OWN}f_{n}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _features(k, s).alias("x")))
        return F.concat(*[made(n) for n in GENERATORS[k]])

    df = df.withColumns({base[k]: passing(k) for k in KINDS})
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    df = df.withColumn(_io.OWN + "taken", F.array_sort(F.concat(*[F.transform(x, place) for x in base.values()])))
    df = without_overlaps(df, {f"{_io.OWN}f_{k}": f"{_io.OWN}m_w_{k}" for k in WIDER}, _io.OWN + "taken")
    df = df.withColumns({f"{_io.OWN}c_{k}": free(k) for k in KINDS})
    return df.drop(_io.OWN + "taken", *[f"{_io.OWN}{x}_{k}" for x in ("m_w", "f") for k in WIDER])


def examples(n: int = 4800, seed: int = 7) -> list[tuple[str, str, int]]:
    """(text, kind, is personal) made from templates; each holds one candidate of its kind."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: rng.choice(["alder", "birch", "cedar", "maple", "orion", "river", "stone", "willow", "nora", "felix", "ivan", "mara"])
    filler = lambda: " ".join(word() for _ in range(rng.randint(2, 5)))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, body)))
        return body + str(-total % 10)

    def wrong(c: str) -> str:
        return c[:-1] + str((int(c[-1]) + rng.randint(1, 9)) % 10)

    cut = lambda c, sep, *sizes: sep.join(c[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    four = lambda c, sep: cut(c, sep, 4, 4, 4, 4)
    hexes = lambda k: ":".join(rng.choice([num(rng.choice([1, 3, 4])), f"{rng.randrange(1 << rng.choice([3, 8, 16, 16])):x}"]) for _ in range(k))
    sep, top = lambda: rng.choice(" .-"), lambda: rng.choice(["com", "org", "net", "de", "fr", "io", "eu"])

    def issued(size: int) -> str:
        body = rng.choice(["34", "37"] if size == 15 else ["30", "36", "38"]) + num(size - 3)
        return next(body + e for e in "0123456789" if sum((2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(map(int, reversed(body + e)))) % 10 == 0)

    def spelt() -> str:
        at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), ("(at)", "."), ("[at]", "."), (" {at} ", " {dot} "), (" <at> ", " <dot> "), (" @ ", "."), ("@ ", " . "), (" @ ", " dot "), (" [AT] ", " [DOT] ")])
        return f"{rng.choice([word(), word() + '.' + word(), word() + num(2)])}{at}{word()}{dot}{top()}"

    def dialled() -> str:
        s, z = sep(), rng.choice("123456789")
        return rng.choice([
            f"({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}",
            s.join(["0" + z, *(num(2) for _ in range(4))]), f"00{num(2)} {s.join([z, *(num(2) for _ in range(4))])}", f"0{num(2)}{rng.choice(' /')}{num(7)}", f"0{num(3)} {num(6)}", f"(0{num(2)}) {num(8)}",
            f"0{num(3)} {num(3)} {num(4)}", f"{z}{num(2)}{s}{num(3)}{s}{num(2)}{s}{num(2)}", f"{z}{num(2)} {num(2)} {num(2)} {num(2)}", f"1{s}{num(3)}{s}{num(3)}{s}{num(4)}", z + num(9), "0" + z + num(9),
        ])

    def counted() -> str:  # what is counted or dated has no zero before it
        z = rng.choice("123456789")
        return rng.choice([
            f"{z}{num(2)} {num(3)} {num(3)}", f"{z}{num(3)}-{num(4)}-{num(4)}", f"{z}{num(1)}.{num(3)}.{num(3)}", f"{z}{num(2)}-{num(3)}-{num(4)}", z + num(9), z + num(10), "1" + num(9), f"{z}{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}",
            f"20{num(2)}-0{num(1)}-{num(2)} {num(2)}", f"{z}{num(1)}.{num(2)}.20{num(2)} {num(2)}", f"{z}{num(2)}.{num(3)}.{num(2)}.{num(2)}", f"{z}{num(3)} {num(6)}", f"{z}{num(1)} {num(3)} {num(3)}", f"{z}{num(2)} {num(2)} {num(2)} {num(2)}",
        ])

    out = []
    for _ in range(n):
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        if kind == "email" and good:
            v, lead = spelt(), rng.choice(["email ", "contact ", "write to ", "", "reach me: ", "", "address: "])
            if rng.random() < 0.1:
                v, lead = f"{word()} @ {word()}", rng.choice(["email ", "contact ", "e-mail: ", "write to "])
        elif kind == "email":
            v = rng.choice([f"{word()} at {word()}.{word()}", f"{word()} at {num(1)}.{num(2)}", f"look at {word()}.Then", f"{word()} at {word()}.txt", f"{word()} @ {num(1)}.{num(2)}", f"{word()} @ {word()}", f"{num(2)} @ {num(3)}", f"{word()} at {word()} dot {word()}s", f"{word()} AT {word()}.{word()}"])
            lead = rng.choice(["we met ", "see ", "", "price "])
        elif kind == "ip" and good:
            head, k = rng.choice(["2001", "2a02", "fe80", "2607", "2001:db8", "fd00", "2a00"]), rng.randrange(1, 5)
            v = rng.choice([f"{head}:{hexes(8 - head.count(':') - 1)}", f"{head}::{hexes(k)}", f"{head}:{hexes(2)}::{hexes(k)}", f"{head}::", f"::ffff:{hexes(2)}", f"fe80::{hexes(k)}%eth{num(1)}", f"{head}::{num(1)}"])
            lead = rng.choice(["host ", "from ", "server ", "", "", "ping "])
        elif kind == "ip":
            v, lead = rng.choice([(":".join(num(2) for _ in range(8)), rng.choice(["serial ", "lot ", "ref ", ""])), (f"{rng.choice(['abc', 'dead', 'bed', 'face', 'a'])}::{rng.choice(['add', 'cafe', 'b', 'bad'])}", rng.choice(["", "call ", "see "])), (f"{num(2)}::{num(2)}", rng.choice(["", "page ", "verse ", "ref "])), (f"{num(1)}::{num(1)}", rng.choice(["", "slice "])), (":".join(f"{rng.randrange(256):02x}" for _ in range(8)), rng.choice(["", "wwn ", "serial "]))])
        elif kind == "card" and good:
            s = rng.choice([".", "_", "/", "  ", "\u2013", "\u00a0", "-"])
            v, lead = rng.choice([four(card(), rng.choice([".", "_", "/", "  ", " -"])), four(card(), "."), cut(issued(15), s, 4, 6, 5), cut(issued(14), s, 4, 6, 4)]), rng.choice(["card ", "visa ", "pay with ", "", "", "card no. "])
        elif kind == "card":
            v, lead = rng.choice([four(wrong(card()), rng.choice([".", "/", "_", "  "])), "978" + num(10), num(13), cut(wrong(issued(15)), ".", 4, 6, 5)]), rng.choice(["order ", "isbn ", "", "serial ", "ref "])
        elif good:
            v = dialled()
            distinct = v.startswith(("(", "0")) and not v.isdigit()
            lead = rng.choice(["call ", "phone: ", "tel. ", "mobile ", "fax ", "call me at ", "number is ", "text me ", *([""] * 8 if distinct else [])])
        else:
            v, lead = counted(), rng.choice(["order ", "part ", "", "page ", "ref ", "between ", "invoice ", "model ", "ticket "])
        out.append((f"{filler()} {lead}{v} {filler()}", kind, int(good)))
    return out


def model(spark: SparkSession) -> tuple[float, list, dict[str, float]]:
    """Starting logit, trees, and for each kind the least probability that selects a span (over 1: none does)."""
    if "pii" not in _models:
        made = examples()
        rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps([m[0] for m in made])), "array<string>")).alias("i", "t")).repartition(16, "i")
        got = {r["i"]: r for r in candidates(rows, "t").select("i", *[f"{_io.OWN}c_{k}" for k in KINDS]).collect()}
        xs, ys, ks = [], [], []
        for i, (_, own, good) in enumerate(made):
            for kind, c in ((k, c) for k in KINDS for c in got[i][f"{_io.OWN}c_{k}"]):
                xs.append(list(c["x"]))
                ys.append(good if kind == own else 0)
                ks.append(kind)
        x, y, k = np.array(xs), np.array(ys, float), np.array(ks)
        fit = np.arange(len(y)) % 3 > 0
        base, trees = boost(x[fit], y[fit], 40, 3, least=8)
        p = 1 / (1 + np.exp(-(base + sum(t.predict(x) for t in trees))))
        least = {}
        for kind in KINDS:
            own = ~fit & (k == kind)
            least[kind] = min((float(q) for q in np.linspace(0.8, 0.98, 19) if (own & (p >= q)).any() and y[own & (p >= q)].mean() >= 0.99), default=1.01)
        _models["pii"] = base, trees, least
    return _models["pii"]


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``__cv_spans``: sorted array of (start, order, end, kind, base)."""
    t = _io.OWN + "t"
    base, trees, least = model(docs.sparkSession)
    df = candidates(docs.select(*[f"`{c}`" for c in docs.columns if c != text], _io.text_or_empty(text).alias(t)), t)

    def probability(x: Column) -> Column:
        features = [F.get(x, i) for i in range(len(_FEATURES))]
        total = F.lit(base)
        for tree in trees:
            total = total + tree.column(features)
        return 1 / (1 + F.exp(-total))

    span = lambda s, order, kind, is_base: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(is_base).alias("base"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,base:boolean>>")

    def spans_of(order: int, k: str) -> list[Column]:
        c = F.col(f"{_io.OWN}c_{k}")
        chosen = F.filter(c, lambda s: probability(s["x"]) >= least[k])
        return [F.transform(f"{_io.OWN}m_{k}", lambda s: span(s, order, k, True)), F.when(F.size(c) > 0, F.transform(chosen, lambda s: span(s, order, k, False))).otherwise(none)]

    parts = [p for order, k in enumerate(KINDS) for p in spans_of(order, k)]
    df = df.withColumn(_io.OWN + "all", F.array_sort(F.concat(*parts)))
    every = F.col(_io.OWN + "all")
    once = F.filter(every, lambda x, i: (i == 0) | (x != F.get(every, i - 1)))  # two generators may propose one span
    return df.withColumn(_io.OWN + "spans", once).drop(t, _io.OWN + "all", *[f"{_io.OWN}{m}_{k}" for m in "mc" for k in KINDS])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(_io.read(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col(_io.OWN + "spans")
    base = F.filter(s, lambda x: x["base"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"), F.size(F.filter(s, lambda x: ~x["base"])).cast("long").alias("n_added"))
