"""Goldens and invariants of the operators that SQL can't express."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import markup as m
from quillspark.operators import convert, edits, importer, similarity, verse
from quillspark.sources import files
from quillspark.streaming import machine


def kinds(src):
    return [b["type"] for b in m.parse_blocks(src)]


def test_blocks_fall_back_to_paragraphs():
    src = "## Head one {s1}\n[toc collapsed nonum]\n\np1\np2\n\n[poem title=\"T\"]\nx\n\ny\n[/poem]\n\n[sub]one[/sub]\n\n[epi]\nunclosed"
    blocks = m.parse_blocks(src)
    assert [b["type"] for b in blocks] == ["heading", "toc", "paragraph", "poem", "sub", "paragraph"]
    assert blocks[0]["slug"] == "s1" and blocks[3]["inner"] == "x\n\ny" and blocks[3]["attrs"] == {"title": "T"}
    assert blocks[5]["text"] == "[epi]\nunclosed"
    assert kinds("") == [] and kinds("\n\n") == []


def test_notes_keep_empty_and_missing_labels_apart():
    notes = m.parse_notes("[^1]: a\n    b\n\n[^g.2]: c\n[^*]: d\n[^]: e\n[^|]: f\n[^|See]: h\n[^|**]: i")
    assert [n["kind"] for n in notes] == ["numbered", "numbered", "starred", "anon", "anon", "anon", "starred"]
    assert notes[0]["body"] == "a\nb" and "prefix" not in notes[3] and notes[4]["prefix"] == ""


def test_attributes():
    assert m.attributes('="L x" k=v q="a b" flag') == {"label": "L x", "k": "v", "q": "a b", "flag": "true"}


def test_similarity_is_the_matching_block_ratio():
    assert abs(similarity.ratio("kitten", "sitting") - 8 / 13) < 1e-9
    assert similarity.ratio("", "x") == 0.0


def test_verse_costs():
    assert [verse.line_cost(n, 8) for n in (8, 7, 6, 9, 10)] == [0.0, 1.2, 3.0, 2.0, 4.5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=9), st.integers(5, 9))
def test_verse_split_is_cheapest(sizes, meter):
    groups = [verse.Group("w", n, None, k, k + 1) for k, n in enumerate(sizes)]
    cost = lambda cuts: sum(verse.line_cost(sum(sizes[a:b]), meter) for a, b in cuts)

    def every(at):
        if at == len(sizes):
            yield []
        for end in range(at + 1, len(sizes) + 1):
            if sum(sizes[at:end]) <= meter + 6 or end == at + 1:
                for rest in every(end):
                    yield [(at, end), *rest]

    assert abs(cost(verse.split_lines(groups, meter)) - min(map(cost, every(0)))) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=20), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=5))
def test_edits_never_overlap(text, spans):
    out, done = edits.apply_edits(text, [{"start": a, "end": b, "text": "#"} for a, b in spans])
    assert out.count("#") == done <= len(spans)


def test_balanced_json_and_regions():
    assert edits.balanced_json('x {bad} {"a": [1]} y') == '{"a": [1]}'
    assert edits.balanced_json("none {") is None
    assert edits.outside("a<i>a</i>a<i>a", "<i>", "</i>", str.upper) == "A<i>a</i>A<I>A"
    assert edits.elide("same", "same") == ("…" * 0 + "same", "same")


def test_convert_covers_and_isolates():
    page = "<html><head><title>t</title></head><body><h1>T</h1><div><h2>Two</h2><p>a <em>b</em><br>c</p><ul><li>x</li></ul></div></body></html>"
    out = importer.imported(page)
    assert out["title"] == "T" and "## Two" in out["markup"] and "a _b_\nc" in out["markup"] and out["coverage"] == 1.0
    assert importer.imported(None)["error"] is None
    html = convert.render(out["markup"])["html"]
    assert '<h2 id="two">Two ' in html and "<em>b</em>" in html


def test_retry_machine():
    assert machine.replay([(0, "poll"), (10, "live")])["phase"] == "ready"
    many = [(i * 160.0, "poll") for i in range(20)]
    assert machine.replay(many)["phase"] == "failed"
    state = machine.batch_step({"phase": "running", "stall": 0}, "limit", 0.0, 100.0)
    assert state["phase"] == "sleeping" and state["until"] == 160.0
    assert machine.batch_step({"phase": "running", "stall": 9}, "fail", 0.0)["phase"] == "stalled"


def test_file_sources(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "A1.doc").write_text("one\ntwo", encoding="utf-8")
    (docs / "B2.doc").write_text("b", encoding="utf-8")
    (docs / "skip.txt").write_text("# c\n\nx\n", encoding="utf-8")
    found = {r.art: r.src for r in files.documents(spark, str(docs)).collect()}
    assert found["A1"] == "one\ntwo" and "skip" not in found
    assert [r.art for r in files.documents(spark, str(docs), ["A1"]).collect()] == ["A1"]
    assert [r.line for r in files.comment_free(spark, str(docs / "skip.txt")).collect()] == ["x"]
    assert {r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path), ["skip.txt"], ["none"]).collect()} == {"A1.doc", "B2.doc"}
    (tmp_path / "w.xml").write_text('<r><work url="u" link="l"/><work url="v" link="k"/></r>', encoding="utf-8")
    assert {(r._url, r._link) for r in files.xml_rows(spark, str(tmp_path / "w.xml")).collect()} == {("u", "l"), ("v", "k")}
    (tmp_path / "j.json").write_text('{"a": 1,\n "b": ["x"]}', encoding="utf-8")
    assert files.json_table(spark, str(tmp_path / "j.json"), "a int, b array<string>").first().b == ["x"]
    out = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.publish(out, str(tmp_path / "pub"))
    again = spark.read.parquet(str(tmp_path / "pub"))
    assert files.publish_changed(out, again, "k").count() == 0
    assert files.remaining(out, again.filter("k = 1"), "k").count() == 1


def test_results_do_not_depend_on_row_order(spark):
    from quillspark.operators import sequence

    rows = [(i % 5, i, random.Random(i).randrange(9)) for i in range(60)]
    a = spark.createDataFrame(rows, "g int, n int, x int")
    b = spark.createDataFrame(rows[::-1], "g int, n int, x int").repartition(7)
    for df in (a, b):
        got = sorted(map(tuple, sequence.global_number(df.withColumn("x", F.col("x").cast("long")), "x", ["n"]).select("n", "rank").collect()))
        want = sorted((n, i) for i, (_, n) in enumerate(sorted((x, n) for _, n, x in rows), 1))
        assert got == want


def test_null_and_empty_text(spark):
    from quillspark.functions import dates, text

    rows = spark.createDataFrame([(None,), ("",), ("\r\n",)], "s string")
    got = rows.select(text.slug(F.col("s")), text.caps_ratio(F.col("s")), text.newlines(F.col("s")), dates.first_date(F.col("s")), m.frontmatter(F.col("s")), m.parse_document(F.col("s"))).collect()
    assert len(got) == 3 and got[1][0] == "section" and got[2][2] == "\n"


def test_state_stream_equals_replay(spark, tmp_path):
    rows = [(1, 0.0, "poll"), (1, 10.0, "live"), (2, 0.0, "poll"), (2, 50.0, "failed"), (3, 0.0, "poll")]
    later = [(2, 210.0, "poll"), (2, 220.0, "dismiss"), (3, 100.0, "poll")]
    schema = "id int, at_s double, kind string"
    for part in (rows, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = machine.state_stream(stream, "id", "at_s", "kind")
    query = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {r.id: (r.phase, r.tries) for r in machine.replay_all(spark.createDataFrame(rows + later, schema), "id", "at_s", "kind").collect()}
    seen = [(r.id, (r.phase, r.tries)) for r in spark.table("states").collect()]
    assert all((k, v) in seen for k, v in batch.items())


def test_folders_keep_old_or_new(spark, tmp_path):
    from quillspark.sources.folders import Folder

    where = Folder(spark, str(tmp_path / "f"))
    assert where.read("x") is None and where.load_state("s", lambda: {"n": 0}) == {"n": 0}
    where.write("s", "[1]")
    assert where.load_state("s", lambda: {"n": 1}) == {"n": 1} and "s.bad" in where.names()
    where.save_state("s", {"n": 2})
    assert where.load_state("s", dict) == {"n": 2}
    for n in "abc":
        where.write(n, n)
    assert where.renamed({"a": "b", "b": "c", "c": "a", "none": "z"}) == {"a": "moved", "b": "moved", "c": "moved", "none": "missing"}
    assert [where.read(n) for n in "abc"] == ["c", "a", "b"]
    one = where.commit({"p": "1", "q": "2"}, None)
    two = where.commit({"p": None, "r": "3"}, one)
    assert where.committed(one) == {"p": "1", "q": "2"} and where.committed(two) == {"q": "2", "r": "3"} and where.commit({}, one) is None
    assert where.lock("l", "x", 0.0, lambda o: True) and not where.lock("l", "y", 10.0, lambda o: True)
    assert where.lock("l", "y", 10.0, lambda o: False) and where.lock("l", "z", 4000.0, lambda o: True)


def test_verse_overrides_and_dictionary():
    assert verse.dictionary(["# c", "", "a b 2", "x -1"]) == {"a b": 2, "x": -1}
    for bad in ("word", "word x"):
        try:
            verse.dictionary([bad])
            raise AssertionError(bad)
        except ValueError:
            pass
    assert verse.override_blocks("# c\na b\n\n \nc\r\nd\n") == [["a b"], ["c", "d"]]
    text = "да ну же ты был тут да ну"
    cut = verse.segmented(text, 5, overrides="же ты\nбыл тут")
    assert [x["text"] for x in cut["lines"]][1:3] == ["же ты", "был тут"] or "был тут" in [x["text"] for x in cut["lines"]]
    assert verse.segmented(text, 5, overrides="да ну")["error"] and verse.segmented(text, 5, overrides="нет такого")["error"] is None
    labels = [x["label"] for x in verse.segmented("=== One ===\nда ну да ну да\n\nну да ну да ну", 5)["lines"]]
    assert labels == ["One", verse.PARAGRAPH]


def test_first_date_beside_letters(spark):
    from quillspark.functions import dates

    rows = spark.createDataFrame([("ж1.2.2003",), ("(1.2.2003)",), ("1.2.2003г",), ("",), (None,)], "x string")
    assert [str(r[0]) for r in rows.select(dates.first_date(F.col("x"))).collect()] == ["None", "2003-02-01", "None", "None", "None"]


def test_importer_isolates_and_covers():
    page = "<body>" + "".join(f'<div class="w{i}"><p>para {i} with <a href="#n{i}">words</a></p></div>' for i in range(50)) + "<table><tr><td>x</td></tr></table></body>"
    out = importer.imported(page)
    assert out["coverage"] == 1.0 and out["markup"].count("para ") == 50 and out["kind"] == "prose"
    deep = importer.imported("<div>" * 3000 + "x")  # deeper than the walk goes
    assert deep["markup"] is None and deep["error"]
