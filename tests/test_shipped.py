import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

JOB = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
sys.path.insert(0, sys.argv[1])
from tidemark.functions.storage import ship

def found(batches):
    import tidemark.functions.storage as module
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"file": [module.__file__]})

for _ in range(2):
    ship(spark, Path(sys.argv[1]), "tidemark", "not_there.py")
print("FOUND", *{r.file for r in spark.range(0, 8, 1, 4).mapInArrow(found, "file string").collect()})
"""


def test_workers_elsewhere_get_the_library(tmp_path):
    """Executors are processes of their own, without a path to the repository: their code comes from the archive."""
    import pyspark

    (tmp_path / "job.py").write_text(JOB)
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # where executors start
    for part in Path(pyspark.__file__).parent.iterdir():
        if part.name != "work":
            (home / part.name).symlink_to(part)
    own = {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | own
    ran = subprocess.run([sys.executable, "job.py", str(ROOT), f"file://{tmp_path}/shared"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    found = [line for line in ran.stdout.splitlines() if line.startswith("FOUND")]
    assert found, ran.stderr[-2000:]
    assert all(".zip/" in f for f in found[0].split()[1:])
    assert not list((tmp_path / "shared").glob("tidemark-*"))
