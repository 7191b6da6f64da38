"""A sample of registered queries beside their SQL oracles (all of them: tools/check.py)."""

import os

import duckdb
import pytest

from weftgraph import catalog
from weftgraph.compare import compare_frames, duck_connection

SF = os.environ.get("WEFT_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "calls_by_file", "function_context", "file_dependencies", "normalize_repo_path",
    "rule_invalid_target", "structure_canonical", "records_current", "lane_page",
    "exports_pattern_select", "stream_change_rate",
]

catalog.load()


@pytest.fixture(scope="module")
def con():
    return duck_connection(duckdb, SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_its_oracle(spark, con, key):
    got = catalog.QUERIES[key](spark, SF).toPandas()
    assert len(got) and compare_frames(got, con.execute(catalog.ORACLES[key]).fetchdf()) == ""


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
