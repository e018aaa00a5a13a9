import duckdb
import pytest

from versify.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_twin(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM read_parquet('{SF}/{name_}.parquet')")
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rel = con.execute(registry.oracle_sql()[name])
    found = [d[0] for d in rel.description]
    assert sorted(found) == columns
    want = sorted(tuple(row[found.index(c)] for c in columns) for row in rel.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want
