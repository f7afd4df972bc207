"""Trees of a file a row: written by many tasks, opened once."""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa

from corvane.plans import readers
from corvane.sources import files, rdf


def _suppliers(spark, folder, n=60):
    spark.range(n).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "CAST(id % 25 AS INT) AS s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def _writers(path):
    """The numbers of the tasks that wrote the files below ``path``."""
    return {re.search(r"part-(\d+)", f.name)[1] for f in Path(path.removeprefix("file:")).rglob("part-*.txt")}


def test_records_are_written_by_many_tasks(spark, tmp_path):
    sf = _suppliers(spark, tmp_path)
    for flat in (True, False):
        path = readers._record_tree(spark, sf, flat)
        assert len(list(Path(path.removeprefix("file:")).rglob("part-*.txt"))) == 60 + 6 * (not flat)
        assert len(_writers(path)) > 1


def test_existing_records_open_each_file_once(spark, tmp_path):
    path = readers._record_tree(spark, _suppliers(spark, tmp_path), True)
    done = spark.createDataFrame([("m1", "c0", "s10"), ("m1", "c0", "s10"), ("m1", "c1", "s7")], "model string, config string, id string")
    got = files.existing_records(spark, path, done, "*.txt")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1
    every = files.existing_records(spark, path, None, "*.txt")
    assert got.count() == every.count() - 2 and got.columns == every.columns


def test_artefacts_are_written_by_many_tasks(spark, tmp_path):
    expected, texts = readers._artefacts(spark, _suppliers(spark, tmp_path))
    assert expected.count() == 60 and texts.count() == 48
    assert len({re.search(r"part-(\d+)", r.rel_path)[1] for r in texts.select("rel_path").collect()}) > 1


def test_pitfalls_are_made_in_one_pass(spark):
    o, rdf_type = "http://oops.linkeddata.es/def#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    rows = [("r", "b", rdf_type, o + "pitfall"), ("r", "b", o + "hasCode", " P01"), ("r", "b", o + "hasAffectedElement", "e"), ("r", "c", rdf_type, o + "other"), ("r", "c", o + "hasCode", "P02"), ("r", "d", rdf_type, o + "pitfall"), ("s", "b", o + "hasCode", "P03")]
    triples = spark.createDataFrame(rows, "graph_id string, s string, p string, o string").repartition(2)
    got = files.pitfalls_of(triples)
    assert [(r.report, r.node, r.code, r.importance, r.affected, r.elements) for r in got.collect()] == [("r", "b", "P01", None, 1, ["e"])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_triples_of_small_texts_share_batches(spark):
    texts = spark.range(50).selectExpr("concat('g', id) AS graph_id", "concat('<http://e/', id, '> <http://e/p> <http://e/o> .') AS text").coalesce(1)
    sizes = rdf.triples(texts).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    assert sum(r.n for r in sizes.collect()) == 50 and sizes.count() < 50
