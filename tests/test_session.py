"""The entry without the training-data libraries, the shared folder and the clean-up of what was written."""

import subprocess
import sys
from types import SimpleNamespace

import pytest

from redolent import session
from redolent.queries import QUERIES


def test_entry_lists_the_rest_where_a_library_is_missing():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=session.Path(__file__).parent.parent)
    assert int(out.stdout.split()[0]) == len(QUERIES)


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://h:7077", getConf=lambda: conf, applicationId="x"))
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)


def test_written_tables_are_swept(spark):
    session.sweep(spark)
    df = session.materialize(spark.range(5), "swept")
    assert df.count() == 5
    path = session._WRITTEN[spark.sparkContext.applicationId][0].removeprefix("file://")
    assert session.Path(path).exists() and session.sweep(spark) == 1 and not session.Path(path).exists()
