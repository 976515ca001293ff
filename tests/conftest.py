import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pkgsift.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app_name="pkgsift-tests")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pkgsift-test-ckpt-"))
    yield s
    s.stop()


def java_files_df(spark, files):
    """files: list of (project_id, relative_path, content)."""
    rows = [(p, f"/corpus/{p}/{r}", r, c) for p, r, c in files]
    return spark.createDataFrame(rows, "project_id bigint, file_path string, relative_path string, content string")
