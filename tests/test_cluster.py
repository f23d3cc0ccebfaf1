"""What a cluster needs: the package on the workers, a shared folder, tables that can be dropped."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from pairsieve.session import drop_scratch, run_dir, shared_dir, written

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

ELSEWHERE = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from pairsieve.session import build_session
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}})
for name in ("j2_surrogate_fit", "h49_toeplitz_large", "m1_session_keys"):
    entry.queries()[name](spark, {SF!r}).collect()  # may be empty on so small a table
spark.stop()
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="input tables not present")
def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(session("local-cluster[2,1,1024]"))
    assert shared_dir(session("spark://host:7077", "hdfs://store/x")) == "hdfs://store/x"
    assert os.path.isdir(shared_dir(session("local[2]")))


def test_intermediate_tables_can_be_dropped(spark, monkeypatch):
    from pairsieve import session as module

    monkeypatch.setattr(module, "run_dir", lambda s: os.path.join(shared_dir(s), "pairsieve", "drop-test"))
    written(spark.range(3).toDF("x"), "rows")
    folder = os.path.join(shared_dir(spark), "pairsieve", "drop-test").removeprefix("file:")
    assert os.listdir(folder)
    drop_scratch(spark)
    assert not os.path.exists(folder)
    assert run_dir is not module.run_dir
