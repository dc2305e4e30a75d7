"""Shared files go with the application that wrote them."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
from pyspark.sql import SparkSession
from strandloom.sources.scratch import kept
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {root!r}).getOrCreate()
assert kept(spark.range(5), "x").count() == 5
import os
assert sum(x.startswith("strandloom-files") for x in os.listdir({root!r})) == 1
spark.stop()
"""


def test_files_are_cleared(tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    subprocess.run([sys.executable, "-c", CODE.format(root=str(tmp_path))], check=True, env=env, timeout=120)
    assert not [x for x in os.listdir(tmp_path) if x.startswith("strandloom")]
