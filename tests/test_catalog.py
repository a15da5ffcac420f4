"""Every registered query against its DuckDB text on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_equals_oracle(spark, con, key):
    assert compare(spark, con, SF, key, QUERIES[key], ORACLES.get(key)) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "linha_afetada", "estado", "ocorrencias_criticas", "menor_distancia_km", "intensidade_maxima_fogo"
    ]
