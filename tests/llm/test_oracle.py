import duckdb

from rivulet.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_top_k_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rel = con.sql(ORACLE_SQL["op5_exact_top_k"])
    got = QUERIES["op5_exact_top_k"](spark, SF)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
