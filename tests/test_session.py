"""Scratch tables with and without a configured folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from corvane.session import shared_dir

ROOT = Path(__file__).resolve().parent.parent
PLAIN = """
import sys
sys.path.insert(0, sys.argv[1])
from corvane.operators.graph import components
from corvane.session import local_session, shared_dir

spark = local_session(2, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "x", "y")], "graph_id string, a string, b string")
print(sorted(map(tuple, components(edges).collect())))
print(shared_dir(spark))
spark.stop()
"""


def test_plain_session_has_a_folder_of_its_own(tmp_path):
    (tmp_path / "plain.py").write_text(PLAIN)
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_SUBMIT")} | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, tmp_path / "plain.py", ROOT], env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-3000:]
    rows, folder = out.stdout.strip().splitlines()[-2:]
    assert rows == "[('g', 'a', 'a'), ('g', 'b', 'a'), ('g', 'c', 'a'), ('g', 'x', 'x'), ('g', 'y', 'x')]"
    assert not list(Path(folder.removeprefix("file://")).glob("corvane-*"))  # scratch tables go with the application


def test_cluster_without_a_folder_is_an_error():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake)
