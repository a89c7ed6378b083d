"""Every registered query of the library gives the rows of its SQL."""

import pytest

import snapdelta.plans.more_queries  # noqa: F401
import snapdelta.plans.source_queries  # noqa: F401
import snapdelta.plans.text_queries  # noqa: F401
from snapdelta.plans.queries import ORACLE, QUERIES

from oracle import connect, rows


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_query_but_one_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"q_word_pairs"}  # held against a plain version in test_lines
