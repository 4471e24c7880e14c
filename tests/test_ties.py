"""Rows that the order of a query's SQL leaves equal."""

import oracle
from oracle import MIDDLE

from weftline.plans import registry, records  # noqa: F401


def test_merged_entities_of_one_number(spark, tmp_path):
    """Lines of one identifier and name but of two types: the first in the table stays, though Spark reads the larger file first.

    That is what DuckDB does with one thread; with more its choice changes with the threads.
    """
    path, con = tmp_path / "lineitem.parquet", oracle.duck(str(tmp_path))
    path.mkdir()
    for k, some in enumerate(("l_partkey % 8 = 0", "true")):
        con.execute(f"COPY (SELECT * REPLACE ((l_suppkey + {k})::BIGINT AS l_suppkey) FROM '{MIDDLE}/lineitem.parquet' WHERE {some}) TO '{path}/part-{k}.parquet' (FORMAT parquet)")
    got = registry.QUERIES["merge_entities"](spark, str(tmp_path)).toPandas()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    assert oracle.rows_of(got) == oracle.rows_of(con.execute(registry.SQL["merge_entities"]).df())
