"""Near-duplicate search writes and shuffles the texts once."""

from __future__ import annotations

import re

from stationclim.llm import near_dup


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_the_kept_rows_are_picked_without_a_shuffle_of_texts(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows + [(100 + i, f"text number {i} of many " * 9 + str(i % 3)) for i in range(60)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_dup.keep_one(docs)
        plan = plan_of(kept)
        assert plan.count("Bucketed: true") >= 1 and len(set(re.findall(r"Exchange hashpartitioning\([^)]*\)[^\n]*", plan))) <= 1, plan
        rows = kept.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert kept.columns == docs.columns
    given = [tuple(r) for r in docs.collect()]
    assert rows and len(rows) < len(given) and all(tuple(r) in given for r in rows)
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, map(tuple, near_dup.keep_one(docs).collect())))


def test_texts_are_written_once(spark, docs_of, odd_rows, monkeypatch):
    """Every frame that the search writes; the representatives' texts had a table of their own."""
    wrote = []
    for name in ("materialise", "materialise_bucketed", "write_bucketed_table"):
        if hasattr(near_dup, name):
            made = getattr(near_dup, name)
            monkeypatch.setattr(near_dup, name, lambda df, *a, made=made: wrote.append(df.columns) or made(df, *a))
    near_dup.keep_one(docs_of(odd_rows)).collect()
    assert sum("text" in columns for columns in wrote) == 1, wrote


def test_no_table_name_is_left(spark, docs_of, odd_rows):
    before = {t.name for t in spark.catalog.listTables()}
    near_dup.keep_one(docs_of(odd_rows)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
