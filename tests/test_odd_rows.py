"""Queries over documents without text or source, or with odd ones, against their SQL."""

from __future__ import annotations

import duckdb

import __spark_entry__


def test_articles_are_formatted_as_the_sql_says(spark, tmp_path):
    texts = [None, "", "   ", "\n", "one two", " lead", "x " * 20]
    sources = ["src1", None, "SRC2", "src_3", "a b"]
    rows = [(7 * len(sources) * i + k, t, "en", s, len(t or "")) for i, t in enumerate(texts) for k, s in enumerate(sources)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = __spark_entry__.queries()["b10_format_article"](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()['b10_format_article']})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
