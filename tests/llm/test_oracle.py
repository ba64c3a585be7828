"""The queries that have SQL, held against it."""

import pytest

from quillrake.llm.queries import ORACLE, QUERIES
from tests.oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLE[name], DATA)


def test_names():
    assert sorted(int(n[2 : n.index("_")]) for n in QUERIES) == list(range(1, 11))
