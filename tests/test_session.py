"""Checkpoint folder: taken from the session when the cluster sets it; a scratch
folder registered with the SparkContext only when it is unset."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from fieldpulse.session import checkpoint_root
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("SETTING", spark.conf.get("spark.checkpoint.dir", None))
a, b = checkpoint_root(spark), checkpoint_root(spark)
assert a == b, (a, b)
spark.range(10).checkpoint().count()          # the folder is usable for checkpoint()
print("ROOT", a)
spark.stop()
"""


def _run(conf_dir):
    env = dict(os.environ, SPARK_CONF_DIR=conf_dir)
    out = subprocess.run([sys.executable, "-c", PROBE.format(root=ROOT)], env=env, capture_output=True,
                         text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = dict(line.split(" ", 1) for line in out.stdout.splitlines() if line.startswith(("SETTING", "ROOT")))
    return lines["SETTING"], lines["ROOT"]


def test_unset_checkpoint_dir_gets_a_scratch_folder():
    setting, root = _run(tempfile.mkdtemp(prefix="fieldpulse-noconf-"))
    assert setting == "None" and "fieldpulse-ckpt-" in root


def test_cluster_checkpoint_dir_is_used():
    conf = tempfile.mkdtemp(prefix="fieldpulse-conf-")
    shared = tempfile.mkdtemp(prefix="fieldpulse-shared-")
    with open(f"{conf}/spark-defaults.conf", "w") as f:
        f.write(f"spark.checkpoint.dir {shared}\nspark.ui.enabled false\n")
    setting, root = _run(conf)
    assert setting == shared and root == shared


def test_unset_checkpoint_dir_is_an_error_on_a_cluster():
    import types

    import pytest

    from fieldpulse.session import checkpoint_root
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        session = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda *a: None))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_root(session)
