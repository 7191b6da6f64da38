import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from weftgraph.session import local_session

    session = local_session("2")  # fixtures are tiny: fewer tasks, faster tests
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session
