"""Every registered query against its oracle, on the smallest data (``compare.py`` runs the larger)."""

import re

import pytest
from compare import compare, oracle_connection

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, oracle, small, name):
    ok, message = compare(spark, oracle, name, QUERIES[name], ORACLES.get(name), small)
    assert ok, message


def test_entry_returns_a_page(spark):
    df = entry.entry(spark)
    assert "domain" in df.columns and df.count() >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    own = {q for q in QUERIES if not re.match(r"op\d+_|pipeline$", q)}
    assert own - set(ORACLES) == {"e4_approximate_top_k", "e4_neighbour_graph"}
