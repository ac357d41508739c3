import pytest

from palimpsest.plans import catalogue, governed, sourced, stored  # noqa: F401

from .oracle import FOLDER, actual, expected


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    if name in catalogue.ORACLE_SQL:
        assert actual(found) == expected(catalogue.ORACLE_SQL[name])
    else:
        assert found.count() > 0
