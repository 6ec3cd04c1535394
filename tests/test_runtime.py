import subprocess
import sys
import time
from pathlib import Path

from platewise import runtime

ROOT = Path(__file__).resolve().parent.parent
REMOTE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "600m").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__
print("rows", __spark_entry__.queries()["parse_lists"](spark, {data!r}).count())
spark.stop()
"""


def test_workers_find_the_package_from_another_folder(data, tmp_path):
    script = tmp_path / "job.py"
    script.write_text(REMOTE.format(root=str(ROOT), data=data))
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows " in done.stdout, done.stderr[-2000:]


def files(df):
    return list(Path(df.table_path.removeprefix("file:")).glob("*"))


def test_tables_are_freed_on_demand(spark):
    one, two = runtime.cut(spark.range(5)), runtime.cut(spark.range(7))
    assert one.count() == 5 and files(one) and files(two)
    runtime.free(one)
    assert not files(one) and two.count() == 7
    runtime.free_all(spark)
    assert not files(two)


def test_cut_leaves_no_shuffle_files(spark, tmp_path):
    from pathlib import Path

    from platewise.runtime import cut

    folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = set(folder.rglob("shuffle_*.data"))
    table = cut(spark.range(1000).repartition(5).groupBy("id").count())
    deadline = time.time() + 10
    while set(folder.rglob("shuffle_*.data")) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not set(folder.rglob("shuffle_*.data")) - before
    assert table.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
