"""Turns as replies, against the query's SQL: numbers below zero or none, and replies about as long as a short one may be."""

import duckdb

from polyagree import catalogue


def test_replies_of_odd_turns(spark, tmp_path):
    texts = [None, "", " ", "nan", "a{b}'", *("x" * n for n in (299, 300, 301, 448, 449, 450, 458, 459, 460))]
    rows = [(i, j, "user", t) for i, t in enumerate(texts) for j in range(8)] + [(-5, 1, "user", "below"), (None, 1, "user", "none"), (3, None, "user", "none")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    order = lambda found: sorted(found, key=repr)
    got = order(tuple(r) for r in catalogue.QUERIES["parsed_replies"](spark, str(tmp_path)).select("conv_id", "turn", "term", "rationale", "status").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == order(con.sql(f"SELECT conv_id, turn, term, rationale, status FROM ({catalogue.ORACLE_SQL['parsed_replies']})").fetchall())
