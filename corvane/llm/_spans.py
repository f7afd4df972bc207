"""Places of regular-expression matches as native columns.

Every step is linear in the text and its matches, for Spark evaluates what a lambda refers to anew for each element and
copies the whole state of a fold at each step. So lambdas refer to columns of an earlier projection only, positions are
running sums of the lengths of gaps and matches, and folds that make arrays run over ``_RUN`` elements at a time: a first
fold sums up each run, the runs' starting states follow from the sums, and a fold a run makes its part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _io

_RUN = 64
_PLACE = "struct<start:int,end:int,value:string,before:string,after:string>"
#: Code points of context before a match; after it there are two.
REACH = 24
_FAR = 2**31 - 1


def none() -> Column:
    return F.array().cast(f"array<{_PLACE}>")


def _runs(name: str) -> Column:
    """The array column ``name`` cut into runs. (It is named twice, which keeps its projection apart.)"""
    n = F.size(F.col(name))
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _RUN).cast("int")), lambda b: F.slice(F.col(name), b * _RUN + 1, F.lit(_RUN)))
    return F.when(n > 0, runs).otherwise(F.slice(F.array(F.col(name)), 1, 0))


def _tail(x: Column) -> Column:
    return F.right(x, F.lit(REACH))


def _pairs(text: Column, pattern: str, found: Column) -> Column:
    """(g, v, b, h) of each match: length of the gap before it, the match, the end of that gap, and the first two code points of what follows a match before."""
    gaps = F.split(text, pattern, -1)
    return F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("v"), _tail(g).alias("b"), F.left(F.concat(g, F.coalesce(F.left(m, F.lit(2)), F.lit(""))), F.lit(2)).alias("h")))


def _starts(runs: str) -> Column:
    """(pos, tail) at the start of each run: the position, and the last code points before it."""
    total = F.transform(F.col(runs), lambda r: F.struct(F.aggregate(r, F.lit(0), lambda a, x: a + x["g"] + F.length(x["v"])).alias("n"), F.aggregate(r, F.lit(""), lambda a, x: _tail(F.concat(a, x["b"], _tail(x["v"])))).alias("t")))
    first = F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail")))
    return F.aggregate(total, first, lambda a, x: F.concat(a, F.array(F.struct((F.element_at(a, -1)["pos"] + x["n"]).alias("pos"), _tail(F.concat(F.element_at(a, -1)["tail"], x["t"])).alias("tail")))))


def _placed(run: Column, start: Column) -> Column:
    """The places of one run's matches, from its (pos, tail)."""
    zero = F.struct(start["pos"].alias("pos"), start["tail"].alias("tail"), none().alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin, end = a["pos"] + x["g"], a["pos"] + x["g"] + F.length(x["v"])
        item = F.struct(begin.alias("start"), end.alias("end"), x["v"].alias("value"), _tail(F.concat(a["tail"], x["b"])).alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("pos"), _tail(F.concat(a["tail"], x["b"], _tail(x["v"]))).alias("tail"), F.concat(a["out"], F.array(item)).alias("out"))

    return F.aggregate(run, zero, step)["out"]


def add_matches(df: DataFrame, text: str, patterns: dict[str, str], only: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``__cv_m_<kind>``: (start, end, value, before, after) of all leftmost, non-overlapping matches of each pattern.

    ``only`` names cheap conditions without which a text has no match. ``text`` must not be null.
    """
    only = only or {}
    own, pairs, runs, starts = ({k: f"{_io.OWN}{x}_{k}" for k in patterns} for x in ("m", "pairs", "runs", "starts"))
    found = {}
    for k, p in patterns.items():
        got = F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))
        found[own[k]] = F.when(only[k], got).otherwise(F.array().cast("array<string>")) if k in only else got
    df = df.withColumns(found)
    df = df.withColumns({pairs[k]: F.when(F.size(own[k]) > 0, _pairs(F.col(text), p, F.col(own[k]))) for k, p in patterns.items()})
    follow = lambda k: F.zip_with(F.col(pairs[k]), F.slice(pairs[k], 2, F.size(pairs[k])), lambda x, y: F.struct(x["g"].alias("g"), x["v"].alias("v"), x["b"].alias("b"), y["h"].alias("after")))
    df = df.withColumns({pairs[k]: F.when(F.size(own[k]) > 0, F.filter(follow(k), lambda x: x["v"].isNotNull())) for k in patterns})
    df = df.withColumns({runs[k]: F.when(F.size(own[k]) > 0, _runs(pairs[k])) for k in patterns})
    df = df.withColumns({starts[k]: F.when(F.size(own[k]) > 0, _starts(runs[k])) for k in patterns})
    places = {k: F.flatten(F.zip_with(F.col(runs[k]), F.slice(starts[k], 1, F.size(runs[k])), _placed)) for k in patterns}
    out = {own[k]: F.when(F.size(own[k]) > 0, v).otherwise(none()) for k, v in places.items()}
    return df.withColumns(out).drop(*pairs.values(), *runs.values(), *starts.values())


def without_overlaps(df: DataFrame, spans: dict[str, str], others: str) -> DataFrame:
    """``df`` with each column ``spans[k]`` (spans apart from each other) as column k without those that overlap a span of ``others``.

    In the order of starts, a span is free if no other one before it reaches beyond its start and the next one begins no
    sooner than it ends.
    """
    event = lambda s, kind, item: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), item.cast(_PLACE).alias("item"))
    col = lambda x, k: f"{_io.OWN}{x}_{k}"
    both = lambda k: (F.size(spans[k]) > 0) & (F.size(others) > 0)
    df = df.withColumns({col("events", k): F.when(both(k), F.array_sort(F.concat(F.transform(others, lambda s: event(s, 0, F.lit(None))), F.transform(s_, lambda s: event(s, 1, s))))) for k, s_ in spans.items()})
    df = df.withColumns({col("runs", k): F.when(both(k), _runs(col("events", k))) for k in spans})

    def reach(r: Column, least: Column) -> Column:
        return F.aggregate(r, least, lambda a, x: F.when(x["kind"] == 0, F.greatest(a, x["end"])).otherwise(a))

    def first(r: Column) -> Column:
        return F.aggregate(r, F.lit(_FAR), lambda a, x: F.when(x["kind"] == 0, F.least(a, x["start"])).otherwise(a))

    def reaches(k: str) -> Column:
        return F.aggregate(F.transform(F.col(col("runs", k)), lambda r: reach(r, F.lit(0))), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x))))

    def nexts(k: str) -> Column:  # the first start in later runs, from the last run to the first
        return F.reverse(F.aggregate(F.reverse(F.transform(F.col(col("runs", k)), first)), F.array(F.lit(_FAR)), lambda a, x: F.concat(a, F.array(F.least(F.element_at(a, -1), x)))))

    state = lambda k: F.arrays_zip(F.slice(reaches(k), 1, F.size(col("runs", k))).alias("reach"), F.slice(nexts(k), 2, F.size(col("runs", k))).alias("next"))
    df = df.withColumns({col("states", k): F.when(both(k), state(k)) for k in spans})

    def free(run: Column, s: Column) -> Column:
        seen = F.aggregate(
            run,
            F.struct(s["reach"].alias("reach"), F.array().cast(f"array<struct<item:{_PLACE},start:int,kind:int,ok:boolean>>").alias("out")),
            lambda a, x: F.struct(
                F.when(x["kind"] == 0, F.greatest(a["reach"], x["end"])).otherwise(a["reach"]).alias("reach"),
                F.concat(a["out"], F.array(F.struct(x["item"].alias("item"), x["start"].alias("start"), x["kind"].alias("kind"), (x["start"] >= a["reach"]).alias("ok")))).alias("out"),
            ),
        )["out"]
        return F.aggregate(
            F.reverse(seen),
            F.struct(s["next"].alias("next"), none().alias("out")),
            lambda a, x: F.struct(
                F.when(x["kind"] == 0, F.least(a["next"], x["start"])).otherwise(a["next"]).alias("next"),
                F.when((x["kind"] == 1) & x["ok"] & (x["item"]["end"] <= a["next"]), F.concat(F.array(x["item"]), a["out"])).otherwise(a["out"]).alias("out"),
            ),
        )["out"]

    done = {k: F.when(both(k), F.flatten(F.zip_with(F.col(col("runs", k)), F.col(col("states", k)), free))).otherwise(F.col(s_)) for k, s_ in spans.items()}
    return df.withColumns(done).drop(*[col(x, k) for x in ("events", "runs", "states") for k in spans])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of (start, order, end, kind, ...), comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
