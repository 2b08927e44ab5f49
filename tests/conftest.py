import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tradelens.session import build_session
    s = build_session(cores=8, shuffle_partitions=8, app="tradelens-tests",
                      checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")),
                      extra={"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
