import pytest

from quillon import catalog
from tests.conftest import SF

NAMES = [n for n in catalog.queries() if not n.startswith("rule_")]


@pytest.mark.parametrize("name", [*NAMES, "rule_http_no_tls"])
def test_query_gives_the_rows_of_its_sql(spark, same_rows, name):
    same_rows(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 17
