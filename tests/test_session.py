import os
import subprocess
import sys
from pathlib import Path

CODE = """
from engramlake.session import local_session, materialise, shared_dir, spread
s = local_session(2, spark__checkpoint__dir={root!r})
assert shared_dir(s, "x").startswith({root!r}), shared_dir(s, "x")
d = materialise(s.range(10), "numbers")
assert d.count() == 10
wide = s.range(100, numPartitions=7)
assert spread(wide) is wide and spread(s.range(100, numPartitions=1)).rdd.getNumPartitions() == 2
"""


def test_shared_folder_comes_from_the_session(tmp_path):
    """Own process: the setting belongs to the session's start."""
    root = str(tmp_path / "shared")
    repo = str(Path(__file__).resolve().parents[1])
    env = {**os.environ, "PYTHONPATH": repo}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert list(Path(root).glob("numbers-*"))


def test_shuffle_files_go_with_a_written_table(spark):
    from engramlake import session

    seen = []

    class Writer:
        option = lambda self, *_: self
        parquet = lambda self, path: (seen.append(spark.conf.get(session.CLEAN)), spark.range(1).write.parquet(path))

    class Frame:
        sparkSession, write, schema = spark, Writer(), spark.range(1).schema

    before = spark.conf.get(session.CLEAN, None)
    assert session.materialise(Frame(), "x").count() == 1
    assert seen == ["true"] and spark.conf.get(session.CLEAN, None) == before
