"""The queries of this subpackage run, and equal their SQL where they have any."""

import pytest

from kinetrail.llm.queries import ORACLE, QUERIES
from tests.oracle import differences, views

FOUND = {
    "p1_found": {"traj_id", "first_frame", "last_frame"}, "p3_found": {"vec_a", "vec_b"}, "p4_found": {"vec_id", "group_id"}, "p6_found": {"vec_id", "cluster_id"},
    "p7_ids": {"doc_id", "ids"}, "p8_found": {"source"}, "p9_found": {"doc_id", "start_char", "end_char"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    if name in ORACLE:
        assert differences(spark, views(small), QUERIES[name], ORACLE[name], small) == ""
        return
    df = QUERIES[name](spark, small)
    assert df.count() > 0
    if name in FOUND:
        assert set(df.columns) == FOUND[name]


def test_round_trip(spark, small):
    assert QUERIES["p7_roundtrip"](spark, small).where("not same").count() == 0
