"""The catalog's queries at the smallest size: those with SQL against it, the others for a stable result."""

import pytest

from quillrake.plans.catalog import ORACLE, QUERIES
from tests.oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLE[name], DATA) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    first = QUERIES[name](spark, DATA)
    assert first.count() > 0 and first.schema == QUERIES[name](spark, DATA).schema


def test_section_titles_of_whole_texts(spark, tmp_path):
    """A title that starts beyond 120 characters is found."""
    rows = [(3, "#" * 70 + " " * 70 + "Far title", "s"), (4, "text", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.path for r in QUERIES["section_paths"](spark, str(tmp_path)).orderBy("block_idx").collect()] == ["Far title"] * 2
