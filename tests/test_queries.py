"""Each query outside the corpus operators against its SQL, on the smallest tables."""

import pytest

from forgeframe.plans import catalogue
from tests.compare import connect, same

SQL, QUERIES = catalogue.oracle_sql(), catalogue.queries()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, connection, name):
    same(QUERIES[name](spark, sf_dir), connection, SQL[name])


@pytest.mark.parametrize("name", ["x05_principal_components", "f03_graph_features", "f11_spanning_lifetimes", "d01_hull", "l01_gaussian_process", "c18_augment", "a_mlp", "a_adaboost", "f08_domain_features", "f12_hydrogen_bonds", "e01_forest_contributions"])
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
