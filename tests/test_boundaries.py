"""What may depend on what."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tideline.session import release, settle, shared_dir, spread

ROOT = Path(__file__).parents[1]


def test_the_rest_stands_without_the_subpackage():
    code = "import sys; sys.modules['tideline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_nothing_else_imports_it():
    for p in (ROOT / "tideline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b.*import", p.read_text()), p


def test_the_rest_stands_with_both_folders_deleted(tmp_path):
    for name in ("__spark_entry__.py", "tideline"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tideline" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0


def test_no_local_checkpoint_and_no_local_temporary_folder():
    for p in (ROOT / "tideline").rglob("*.py"):
        text = p.read_text()
        assert "localCheckpoint" not in text, p
        assert text.count("mkdtemp") == (1 if p.name == "session.py" else 0), p


class _Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "local-cluster[3,2,1024]"

        class _jsc:
            @staticmethod
            def sc():
                return type("Sc", (), {"getCheckpointDir": staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)})())})()


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://https://host"])
def test_a_cluster_must_name_its_shared_folder(master):
    _Cluster.sparkContext.master = master
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Cluster)


def test_intermediate_tables_are_dropped(spark):
    release(spark)
    df, at = settle(spark.range(10).toDF("x"), "probe")
    assert df.count() == 10 and Path(at.removeprefix("file://")).exists()
    assert release(spark) == 1 and not Path(at.removeprefix("file://")).exists()


def test_spread_looks_at_operators_not_at_names(spark, tmp_path):
    spark.range(100).selectExpr("id AS `Sort`", "id AS `Join x`").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df.groupBy("Sort").count()).rdd.getNumPartitions() < 100
