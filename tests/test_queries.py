"""Every registered graph query against its SQL, on the smallest tables."""

import pytest
from oracle import connect, rows, sql_rows

from graphloom import staging
from graphloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_each_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    assert rows(registry.queries()[name](spark, FOLDER)) == sql_rows(con, registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["friend_id", "first_name", "last_name", "creation_date"]


def test_checks_leave_their_result_only(spark):
    registry.queries()["verify_path"](spark, FOLDER).count()  # indexes are built
    before = len(staging._staged)
    assert registry.queries()["verify_path"](spark, FOLDER).count() > 0
    assert len(staging._staged) == before + 1
