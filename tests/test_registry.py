"""Every query with an oracle is compared with it on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_oracle(spark, tables, name):
    ok, text = compare(spark, tables, SF, name)
    assert ok, text


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
