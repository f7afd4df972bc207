"""Evaluation of artefacts end to end, as one plan over all of them; external models are injected callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as S
from ..session import materialize, ship
from ..sources import rdf
from ..sources.files import pitfall_totals
from . import graph as G
from .entailment import reasoned
from .sev import rolled_up, verify


class Contaminated(ValueError):
    """A question that is not the scenario's own: it makes the whole run worthless, so no section may swallow it."""


def check_questions(signatures: DataFrame, authentic: DataFrame) -> DataFrame:
    """``signatures`` if each of their questions (cq) is among the authentic ones; else an error that names one."""
    stray = signatures.select("cq").join(authentic.select("cq"), "cq", "left_anti").first()
    if stray:
        raise Contaminated(f"not an authentic question: {stray.cq!r}")
    return signatures


def _section(x: DataFrame, name: str, kinds: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``x`` with the columns of one section, joined by graph_id, and ``<name>_error``; a section that fails is null and says why."""
    fields = T.StructType.fromDDL(kinds).fields
    try:
        made = materialize(build().select("graph_id", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]))
    except Contaminated:
        raise
    except Exception as e:  # whatever it is, it belongs into the record and leaves the other sections alone
        return x.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields} | {name + "_error": F.lit(f"{type(e).__name__}: {e}"[:300])})
    return x.join(made, "graph_id", "left").withColumn(name + "_error", F.lit(None).cast("string"))


def evaluate(artefacts: DataFrame, mode: str = "ladder", pitfalls: DataFrame | None = None, signatures: DataFrame | None = None, authentic: DataFrame | None = None) -> DataFrame:
    """One record an artefact (graph_id, text): status, note, counts, verdict of the entailment, gate, pitfalls, verification and structural score.

    ``pitfalls`` (report, code, importance) are those found in each artefact, ``signatures`` the questions put to it (see
    ``sev``), of which ``authentic`` (cq), if given, has to hold every one; a question that it does not hold stops the run. What is not given is
    missing and in no score. An artefact without text, or with one that cannot be read or says nothing, keeps its row with a note and scores 0.
    Sections (``metrics``, ``reasoner``, ``oops``, ``cq``) are tables of their own: one that fails is null, its error is in ``errors``, and the
    others stand.
    """
    if signatures is not None and authentic is not None:
        check_questions(signatures, authentic)
    status = rdf.parse_status(artefacts, mode)
    t = materialize(rdf.triples(artefacts, mode))
    x = artefacts.select("graph_id", F.col("text").isNull().alias("absent")).join(status, "graph_id", "left")
    x = _section(x, "metrics", "triples_count long, class_terms long, property_terms long", lambda: G.ontometrics(t).join(G.declared_vocabulary(t), "graph_id", "left"))
    x = _section(x, "reasoner", "consistent boolean, inferred_triples long, unsatisfiable_classes array<string>, silent boolean", lambda: reasoned(t).join(G.vacuous(t).withColumnRenamed("vacuous", "silent"), "graph_id", "left"))
    parsed = F.col("status").isin("parsed", "empty") & ~F.col("absent")
    zero = lambda k: F.coalesce(F.col(k), F.lit(0))
    judged = parsed & F.col("reasoner_error").isNull()
    x = x.withColumn("consistent", F.when(judged, F.coalesce("consistent", F.lit(True)))).withColumn("vacuous", F.coalesce("silent", F.lit(True)))
    x = x.withColumn("gate", S.content_gate(parsed, zero("triples_count"), zero("class_terms"), zero("property_terms")))
    oops, out, names = F.lit(None).cast("double"), [], ["metrics", "reasoner"]
    if pitfalls is not None:
        own = ["pitfalls_total", "pitfalls_important", "pitfalls_critical", "pitfalls_minor"]
        found = lambda: pitfall_totals(pitfalls).withColumnRenamed("report", "graph_id").select("graph_id", *[F.col(k.removeprefix("pitfalls_")).alias(k) for k in own])
        x, names = _section(x, "oops", ", ".join(f"{k} long" for k in own), found), [*names, "oops"]
        oops = 1.0 / (1 + F.col("pitfalls_total"))
        out += own
    if signatures is not None:
        x = _section(x, "cq", "cqs_total long, cqs_passed long, pass_rate double, sev_score double", lambda: rolled_up(verify(t, signatures), "graph_id"))
        out, names = [*out, "cqs_total", "cqs_passed", "pass_rate", "sev_score"], [*names, "cq"]
    note = F.when(F.col("absent"), "not found").when(F.col("status") == "unparseable", "cannot be read").when(F.col("status") == "no_ontology", "holds no artefact")
    errors = F.map_filter(F.create_map(*[v for k in names for v in (F.lit(k), F.col(k + "_error"))]), lambda k, v: v.isNotNull())
    score = S.structural_score(S.consistency_credit(F.col("consistent"), F.col("vacuous")), oops, F.col("gate.cap"))
    return x.select("graph_id", F.when(F.col("absent"), "missing").otherwise(F.col("status")).alias("status"), note.alias("note"), zero("triples_count").alias("triples"), "consistent", "inferred_triples", "vacuous", F.col("gate.gate").alias("gate"), score.alias("score"), *out, errors.alias("errors"))


def from_files(expected: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("model", "config", "id")) -> DataFrame:
    """(graph_id, text) of every expected artefact (keys), from scanned files (keys, text); one without a file has no text and is not lost."""
    name = F.concat_ws("/", *keys)
    return expected.select(*keys).distinct().join(files.select(*keys, "text"), list(keys), "left").select(name.alias("graph_id"), "text")


def call_model(prompts: DataFrame, key: str, prompt: str, call: Callable[[str], tuple[str, str | None]]) -> DataFrame:
    """(key, reply, finish_reason, error) of ``call(prompt)`` for every row; a failing call gives its error, not a failed job."""
    ship(prompts.sparkSession)
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["__p"]:
                try:
                    reply, finish = call(p)
                    out.append((reply, finish, None))
                except Exception as e:  # the service's failure belongs to the record
                    out.append((None, None, str(e)))
            yield pd.DataFrame({key: b[key], "reply": [o[0] for o in out], "finish_reason": [o[1] for o in out], "error": [o[2] for o in out]})

    return prompts.select(key, F.col(prompt).alias("__p")).mapInPandas(run, f"{key} {kind}, reply string, finish_reason string, error string")


def judge_pairs(pairs: DataFrame, key: str, first: str, second: str, call: Callable[[str], tuple[str, str | None]], names: list[str]) -> DataFrame:
    """(key, first_<name>, second_<name>): scores of both, each the mean over both orders of presentation."""
    from ..functions.text import clamped_score
    from ..sources.files import judge_scores

    both = pairs.select(key, F.explode(F.array(F.struct(F.lit(0).alias("swap"), F.concat_ws("\n---\n", first, second).alias("p")), F.struct(F.lit(1).alias("swap"), F.concat_ws("\n---\n", second, first).alias("p")))).alias("x")).select(F.concat_ws("\u0001", key, "x.swap").alias("__k"), "x.p")
    fields = [f"{side}_{n}" for side in ("a", "b") for n in names]
    j = call_model(both, "__k", "p", call).withColumn("j", judge_scores(F.col("reply"), fields))
    parts = F.split("__k", "\u0001")
    j = j.select(parts[0].alias(key), (parts[1] == "1").alias("swap"), *[clamped_score(F.col(f"j.{f}")).alias(f) for f in fields])
    pick = lambda mine, other: F.when(F.col("swap"), F.col(other)).otherwise(F.col(mine))
    return j.groupBy(key).agg(*[F.avg(pick(f"a_{n}", f"b_{n}")).alias(f"first_{n}") for n in names], *[F.avg(pick(f"b_{n}", f"a_{n}")).alias(f"second_{n}") for n in names])
