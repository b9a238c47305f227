"""Every registered query runs on the smallest tables; where it has SQL, both give the same rows."""

import os

import pytest

import __spark_entry__ as entry
from tests.verify import duck, frames_differ

SF = "/root/testdata/sf0.001"
CORE = entry.catalog.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, name):
    got = CORE[name](spark, SF).toPandas()
    sql = entry.catalog.oracle_sql().get(name)
    if sql:
        assert frames_differ(got, duck(SF).execute(sql).fetchdf()) == ""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables aren't here")
def test_fields_of_all_packets(spark):
    sf = "/root/testdata/sf0.01"
    got = CORE["packet_fields"](spark, sf).toPandas()
    assert got["packet_number"].max() > 5000
    assert frames_differ(got, duck(sf).execute(entry.catalog.oracle_sql()["packet_fields"]).fetchdf()) == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "netloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "netloom.llm" not in p.read_text()
