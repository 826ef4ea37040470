"""Every query of the library against its SQL, and what SQL can't express."""

from __future__ import annotations

import pytest

from quartzfolio import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert same(catalog.queries()[name], catalog.oracle_sql()[name], spark, sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).collect()
