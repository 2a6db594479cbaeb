import os
import subprocess
import sys

import pytest

from tidemark.sources import scratch

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["zstandard", "pyarrow.fs", "tidemark.llm", "corpus_pipeline"])
def test_queries_survive_what_is_missing(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'repeat_rate' in e.oracle_sql(), 'pipeline' in e.queries())"
    run = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, timeout=100)
    count, known, pipeline = run.stdout.split()[-3:]
    assert int(count) >= 58 and known == "True" and pipeline == "False", run.stderr


class Session:
    def __init__(self, **conf):
        self.conf = {name.replace("_", "."): value for name, value in conf.items()}
        self.sparkContext = type("Context", (), {"applicationId": "app-1"})


def test_a_cluster_needs_a_shared_folder():
    on = dict(spark_master="spark://host:7077")
    for folder in ("/var/warehouse", "file:/var/warehouse", "file:///var/warehouse"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.scratch_root(Session(**on, **{"spark.sql.warehouse.dir": folder}))
    assert scratch.scratch_root(Session(**on, **{"spark.sql.warehouse.dir": "hdfs://n/w"})) == "hdfs://n/w/tidemark-app-1"
    assert scratch.scratch_root(Session(**on, **{"spark.checkpoint.dir": "/shared/"})) == "/shared/tidemark-app-1"
    assert scratch.scratch_root(Session(spark_master="local[4]", **{"spark.sql.warehouse.dir": "/w"})) == "/w/tidemark-app-1"
