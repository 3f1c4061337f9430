"""The subpackage's queries against their SQL twins, whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from gemstats.llm.oracle import ORACLE
from gemstats.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, canon, type_diff


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert type_diff(df.dtypes, cur.description) == {}
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(columns, cur.fetchall())


def test_all_thirteen_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names
