"""Every registered query beside its SQL, or for rows where there is none."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tallyline.plans import catalog
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_agrees_with_sql(spark, con, name):
    problem = difference(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    if problem == "no rows on either side":  # series too short at this scale: compare at the next one
        problem = difference(QUERIES[name](spark, LARGER), connect(LARGER), ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 25
