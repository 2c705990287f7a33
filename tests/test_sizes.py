"""Queries on tables that the small ones don't stand for: many rows, odd values."""

import datetime

import duckdb
from pyspark.sql import functions as F

from quillspark.operators import importer, sequence, similarity
from quillspark.plans import imports, registry
from tests.compare import compare


def test_conversions_of_a_small_file_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(imports, "PAGES_A_TASK", 20)
    done = imports.convert_lists(spark, "/root/testdata/sf0.001")
    assert done.rdd.getNumPartitions() >= done.count() // 20 > 1


def test_pages_whose_tags_never_close_are_converted_at_any_depth():
    for tag in ("p", "div", "b", "ul><li", "blockquote"):
        done = importer.imported("<h1>T</h1>" + f"<{tag}>x " * 1500)
        assert (done["title"], done["error"]) == ("T", None), tag
        assert done["markup"].count("x") == 1500, tag
    assert importer.harvested('<ol class="notes"><li id="fn1">' + "<b>x" * 1500)[0]["body"] == "x" * 1500


def test_ampersands_of_pages_are_read_as_the_sql_reads_them(spark, tmp_path):
    name = "convert_pages"
    said = ["cut &am", "cut &amp", "all &amp;&amp; of", "a &quot;b&quot; &lt;c&gt; &nbsp;d", "x &copy; y &#39; z &", "R&D"]
    html = [f'<html><div class="ad">Ad {s}</div><article><h1>{s}</h1><p>One {s}<p>Two {s}</article></html>' for s in said]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert compare(spark, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name], con) is None


def test_a_citation_in_capitals_matches_whatever_its_letters(spark):
    text = "Straße, Maß und Gruß: ein weißer Fluß; groß, bloß, süß, heißt, außen, Füße, Grüße, fließt, schließlich. " * 3
    rows = spark.createDataFrame([(text,), ("ﬁne οδός ŉ, said by all of them. " * 4,)], "text string")
    state = similarity.citation_state(F.col("text"), F.upper("text"))
    assert [r[0] for r in rows.select(state).collect()] == ["match", "match"]
    assert rows.select(similarity.citation_state(F.col("text"), F.reverse("text"))).first()[0] == "diff"


def test_day_ids_of_a_crowded_day(spark, tmp_path):
    at = datetime.datetime(2024, 11, 12)
    spark.createDataFrame([(k, at) for k in range(2900)], "o_orderkey long, o_orderdate timestamp").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    for name in ("mint_day_ids", "mint_day_ids_whole"):
        assert compare(spark, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name], con) is None, name
    assert registry.queries()["mint_day_ids_whole"](spark, str(tmp_path)).select("id").distinct().count() == 2900


def test_equal_intervals_are_one(spark):
    rows = spark.createDataFrame([(1, 6, 9), (1, 6, 9), (1, 6, 9), (1, 30, 31)], "k long, a long, b long")
    assert sorted(tuple(r) for r in sequence.merge_intervals(rows, ["k"], "a", "b", 5).collect()) == [(1, 6, 9), (1, 30, 31)]


def test_intervals_of_unknown_starts_and_broken_lengths(spark, tmp_path):
    name = "interval_merge"
    rows = [(1, 3, 2.5), (1, None, 4.0), (1, 11, 1.0), (2, 3, 3.5), (2, 13, 2.7), (2, 22, 1.0), (3, None, 1.0), (3, None, 2.0), (4, 5, None), (4, 5, 2.0), (4, 60, 1.5), (5, 7, None), (5, None, None), (None, 1, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert compare(spark, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name], con) is None
