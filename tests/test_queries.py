"""Registered queries against their oracle SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pitchloom import fixtures as fx
from pitchloom.queries import ORACLES, QUERIES
from pitchloom.queries.registry import swapped
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def agree(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = rows_of(got.to_pandas(), cols)
    assert rows == rows_of(want.to_pandas(), cols)
    assert rows


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_replaced_text_must_be_there():
    assert swapped("SELECT a", "a", "b") == "SELECT b"
    for sql in ("SELECT b", "SELECT a, a"):
        with pytest.raises(ValueError):
            swapped(sql, "a", "c")


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    agree(spark, con, name)


@pytest.mark.parametrize(
    "name",
    [
        "feat1_annotated_features",
        "win1_win2_held_frames",
        "win5_running_best",
        "agg2_hold_weighted_profile",
        "jn1_frames_with_tonic",
        "jn2_frames_in_nyas",
    ],
)
def test_oracle_with_recordings_split_into_blocks(spark, con, name, monkeypatch):
    """Eight frames per block: every recording crosses many block borders."""
    monkeypatch.setattr(fx, "BLOCK_ROWS", 8)
    agree(spark, con, name)
