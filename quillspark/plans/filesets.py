"""Queries over folders of files: documents, catalogues, results, listings, media, state, versions.

Each writes a bounded set of files made of the rows of ``nation`` or ``region`` into the shared folder and reads them
back as the operators do; rows that have no fixed bound are written by the executors.
"""

from __future__ import annotations

import json

from pyspark.sql import Window, functions as F, types as T

from quillspark.functions import text as t
from quillspark.operators import sequence as seq
from quillspark.plans.registry import register
from quillspark.sources import files
from quillspark.sources.folders import Folder, work_folder
from quillspark.sources.tables import literal, table

L = F.lit


def nations(spark, sf_dir):
    """The 25 rows of the table, for files of their own."""
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").limit(25).collect()


def folder(spark, name):
    return Folder(spark, work_folder(spark, name))


@register("corpus_files", "A1", "SELECT 'N'||n_nationkey AS art, 'name: '||n_name||chr(10)||'x' AS src, n_nationkey%2=0 AS asked FROM nation")
def corpus_files(spark, sf_dir):
    """All documents of a folder by their suffix, the id from the name; beside it a list of ids."""
    where = folder(spark, "docs")
    for k, name, _ in nations(spark, sf_dir):
        where.write(f"N{k}.doc", f"name: {name}\nx")
        where.write(f"N{k}.txt", "no document")
    asked = files.documents(spark, where.path, [f"N{k}" for k in range(0, 25, 2)]).select("art", L(True).alias("asked"))
    return files.documents(spark, where.path).join(asked, "art", "left").select("art", "src", F.coalesce("asked", L(False)).alias("asked"))


@register("json_results", "A2 A21", """
SELECT lpad(n_nationkey::VARCHAR,3,'0') AS key, CASE WHEN n_nationkey%3=0 THEN 'third' WHEN n_nationkey%2=0 THEN 'second' ELSE n_name END AS value FROM nation""")
def json_results(spark, sf_dir):
    """Maps of many JSON files as rows; of a key the value of the last file counts."""
    where = folder(spark, "results")
    rows = nations(spark, sf_dir)
    for name, found in (("1", {str(k): n for k, n, _ in rows}), ("2", {str(k): "second" for k, _, _ in rows if k % 2 == 0}), ("3", {f"{k:02d}": "third" for k, _, _ in rows if k % 3 == 0})):
        where.write(f"part-{name}.json", json.dumps({"results": found}, indent=1))
    maps = spark.read.schema("results map<string,string>").json(f"{where.path}/part-*.json", multiLine=True).select(F.explode("results").alias("k", "value"), F.col("_metadata.file_name").alias("file"))
    return maps.groupBy(F.lpad(F.col("k").cast("int").cast("string"), 3, "0").alias("key")).agg(F.max_by("value", "file").alias("value"))


@register("page_files", "A3 C36", """
SELECT 'p'||n_nationkey AS art, n_name||' body' AS text, n_regionkey::BIGINT AS section FROM nation WHERE n_nationkey%5<>4""")
def page_files(spark, sf_dir):
    """Pages of a folder but for the built views: body text without scripts, and the JSON that the page embeds."""
    where = folder(spark, "pages")
    for k, name, region in nations(spark, sf_dir):
        page = f'<html><head><title>no</title><script type="application/json" id="meta">{{"section": {region}}}</script></head><body><script>var x="<b>";</script>{name}<style>p{{}}</style> <i>body</i></body></html>'
        where.write(f"p{k}.view.html" if k % 5 == 4 else f"p{k}.html", page)
    html = spark.read.option("pathGlobFilter", "*.html").text(where.path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("html"))
    kept = html.filter(~F.endswith("file", L(".view.html")))
    inner = F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1)
    meta = F.from_json(F.regexp_extract("html", r'(?s)<script type="application/json"[^>]*>(.*?)</script>', 1), "section long")
    return kept.select(F.regexp_replace("file", r"\.html$", "").alias("art"), t.plain_text(inner).alias("text"), meta["section"].alias("section"))


@register("folder_listing", "A5 B3", "SELECT CASE WHEN n_nationkey%2=0 THEN 'a/' ELSE 'a/b/' END||n_nationkey||'.html' AS path, length(n_name)::BIGINT AS length, true AS dated FROM nation WHERE n_nationkey%7<>0")
def folder_listing(spark, sf_dir):
    """All files below a folder but for some folders and names, with size and time of change."""
    where = folder(spark, "site")
    for k, name, _ in nations(spark, sf_dir):
        where.write(f"{'drafts' if k % 7 == 0 else 'a' if k % 2 == 0 else 'a/b'}/{k}.html", name)
        where.write(f"a/{k}/index.txt", "skipped by its name")
    found = files.listing(spark, where.path, ["index.txt"], ["drafts"])
    return found.select(F.substring_index("path", f"{where.path.rsplit('/', 1)[-1]}/", -1).alias("path"), "length", F.col("modified").isNotNull().alias("dated"))


@register("line_lists", "A9 A10", "SELECT n_name AS line FROM nation WHERE n_nationkey%4<>0")
def line_lists(spark, sf_dir):
    where = folder(spark, "lists")
    where.write("list.txt", "# names\n\n" + "\n".join(f"#{n}" if k % 4 == 0 else f"  {n} " for k, n, _ in nations(spark, sf_dir)) + "\n   \n")
    return files.comment_free(spark, f"{where.path}/list.txt")


@register("bad_dictionary_lines", "A10", "SELECT n_nationkey, n_nationkey%3=0 AS bad, CASE WHEN n_nationkey%3<>0 THEN n_nationkey-5 END::BIGINT AS n FROM nation")
def bad_dictionary_lines(spark, sf_dir):
    """``token N`` lines, cut at the last space; a line that has no number is an error of its own."""
    line = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat("n_name", L(" and "), (F.col("n_nationkey") - 5).cast("string")))
    n = F.regexp_extract(line, r"^(.*\S) (-?\d+)$", 2)
    return table(spark, sf_dir, "nation").select("n_nationkey", (n == "").alias("bad"), F.nullif(n, L("")).cast("long").alias("n"))


@register("pcm_levels", "A16 F13", """
WITH s AS (SELECT l_suppkey%50 AS track, count(*) AS n, sum(((l_partkey*97)%65536-32768)*((l_partkey*97)%65536-32768))/count(*) AS power FROM lineitem GROUP BY 1) SELECT track, n, round(sqrt(power),6) AS rms FROM s""")
def pcm_levels(spark, sf_dir):
    """Samples of sixteen bits, little end first, decoded from the bytes of media blocks; a track's level comes from its blocks' sums."""
    sample = (F.col("l_partkey") * 97) % 65536 - 32768
    word = F.lpad(F.hex(F.pmod(sample, L(65536))), 4, "0")
    swapped = F.concat(F.substring(word, 3, 2), F.substring(word, 1, 2))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("track"), F.floor(F.col("l_orderkey") / 1000).alias("block"), swapped.alias("w"))
    media = rows.groupBy("track", "block").agg(F.unhex(F.array_join(F.collect_list("w"), "")).alias("pcm"))  # a block holds the lines of a thousand orders

    @F.udf(T.StructType().add("n", "long").add("power", "double"), useArrow=True)
    def decoded(pcm):
        import numpy as np

        x = np.frombuffer(pcm, "<i2").astype(np.float64)
        return {"n": x.size, "power": float((x * x).sum())}

    sums = media.select("track", decoded("pcm").alias("d")).groupBy("track").agg(F.sum("d.n").alias("n"), F.sum("d.power").alias("power"))
    return sums.select("track", "n", F.round(F.sqrt(F.col("power") / F.col("n")), 6).alias("rms"))


@register("source_paragraphs", "A20 E13", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber<=4 AND l_orderkey%5<>0 THEN 'Words of '||l_linenumber||' in '||(l_orderkey%25) END AS said FROM lineitem""")
def source_paragraphs(spark, sf_dir):
    """The words of a chapter's paragraph, tags stripped; a paragraph that isn't there is null."""
    html = F.concat(*(F.concat(L(f'<p id="p{k}">§{k}. <i>Words</i> of {k} in <b>'), F.col("n_nationkey").cast("string"), L("</b></p>")) for k in range(1, 5)))
    paras = F.transform(F.regexp_extract_all(html, L(r"(<p id=\"p\d+\">.*?</p>)"), L(1)), lambda p: F.struct(F.regexp_extract(p, r'id="p(\d+)"', 1).cast("int").alias("n"), F.regexp_replace(F.regexp_replace(p, "<[^>]+>", ""), r"^§\d+\.\s*", "").alias("said")))
    source = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ch"), F.explode(paras).alias("p")).select("ch", F.col("p.n").alias("l_linenumber"), "p.said")
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey") % 25).cast("long").alias("ch"))
    return asked.join(source, ["ch", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "said")


@register("chapter_pages", "A13 A22 F7 F8", """
WITH a AS (SELECT o_custkey AS ch, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey%40 AS first, o_orderkey%40+o_orderkey%3 AS last FROM orders),
p AS (SELECT ch, n, unnest(range(first, last+1)) AS para FROM a), d AS (SELECT ch, count(*) AS twice FROM (SELECT ch, para FROM p GROUP BY 1,2 HAVING count(*)>1) GROUP BY 1)
SELECT a.ch, count(*) AS n_articles, min(first) AS para_min, max(last) AS para_max, coalesce(any_value(twice),0) AS repeated FROM a LEFT JOIN d ON d.ch=a.ch GROUP BY 1""")
def chapter_pages(spark, sf_dir):
    """The index of references from chapters' pages: titles, first and last paragraph, and paragraphs that stand in two articles."""
    first = F.col("o_orderkey") % 40
    paras = F.transform(F.sequence(first, first + F.col("o_orderkey") % 3), lambda k: F.concat(L("<p>§"), k.cast("string"), L(". text</p>")))
    page = F.concat(L("<html><title>Part "), F.col("o_orderkey").cast("string"), L(" | Site</title><body>"), F.array_join(paras, "\n"), L("<p>no § 99. here</p></body></html>"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ch"), page.alias("html"))
    read = pages.select("ch", F.regexp_extract("html", r"<title>([^|<]+?)\s*\|", 1).alias("title"), F.transform(F.regexp_extract_all("html", L(r"<p>§(\d+)\."), L(1)), lambda x: x.cast("long")).alias("paras"))
    known = read.filter("title <> ''").groupBy("ch").agg(F.count("*").alias("n_articles"), F.min(F.array_min("paras")).alias("para_min"), F.max(F.array_max("paras")).alias("para_max"))
    twice = read.select("ch", F.explode("paras").alias("para")).groupBy("ch", "para").count().filter("count > 1").groupBy("ch").agg(F.count("*").alias("repeated"))
    return known.join(twice, "ch", "left").fillna(0, ["repeated"])


@register("tile_markup", "B17 A19 C13", """
SELECT CASE WHEN p_partkey%5=0 THEN 'own title' ELSE p_name END AS title, CASE WHEN p_partkey%5=0 THEN 'own' WHEN p_partkey%3=0 THEN '' ELSE p_brand END AS author,
 lpad(p_partkey::VARCHAR,11,'-')||' | '||CASE WHEN p_partkey%5=0 THEN 'own title' ELSE replace(p_name,'|',chr(92)||'|') END||CASE WHEN p_partkey%5=0 THEN ' | own' WHEN p_partkey%3=0 THEN '' ELSE ' | '||p_brand END AS line FROM part""")
def tile_markup(spark, sf_dir):
    """Tiles from captions: split at the last dash, an override first, no empty author slot."""
    key, name = F.col("p_partkey"), F.col("p_name")
    caption = F.when(key % 3 == 0, name).otherwise(F.concat(name, L(" — "), F.col("p_brand")))
    own = table(spark, sf_dir, "part").filter(key % 5 == 0).select("p_partkey", F.array(L("own title"), L("own")).alias("own"))
    split = F.when(F.contains(caption, L(" — ")), F.array(F.regexp_extract(caption, r"^(.*) — ", 1), F.substring_index(caption, " — ", -1))).otherwise(F.array(caption, L("")))
    rows = table(spark, sf_dir, "part").select("p_partkey", split.alias("found")).join(own, "p_partkey", "left").select("p_partkey", F.coalesce("own", "found").alias("f"))
    parts = F.filter(F.array(F.lpad(F.col("p_partkey").cast("string"), 11, "-"), t.field_escape(F.col("f")[0]), F.col("f")[1]), lambda x: x != "")
    return rows.select(F.col("f")[0].alias("title"), F.col("f")[1].alias("author"), F.array_join(parts, " | ").alias("line"))


@register("label_overrides", "A19 E3", "SELECT p_partkey, p_size::BIGINT AS n, p_partkey%3=0 AS own FROM part WHERE p_partkey%7<>0")
def label_overrides(spark, sf_dir):
    """Labels of a built index: ``#number`` links, and whether the number that they show is one of their own."""
    shown = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).otherwise(F.col("p_partkey"))
    html = F.concat(L('<li><a href="#'), F.col("p_size").cast("string"), L('">#'), shown.cast("string"), L("</a></li>"))
    html = F.when(F.col("p_partkey") % 7 == 0, "<li># plain</li>").otherwise(html)
    read = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(html, r'href="#(\d+)"', 1).alias("n"), F.regexp_extract(html, r">#(\d+)<", 1).alias("x"), shown.alias("shown"))
    return read.filter("n <> ''").select("p_partkey", F.col("n").cast("long").alias("n"), (F.col("p_partkey") % 3 == 0).alias("own"))


@register("two_phase_rename", "B15", """
SELECT old, CASE WHEN old IN ('n0','n1') THEN 'moved' WHEN old='n2' THEN 'taken' ELSE 'missing' END AS outcome FROM (SELECT 'n'||n_nationkey AS old FROM nation WHERE n_nationkey<3 UNION ALL SELECT 'gone')""")
def two_phase_rename(spark, sf_dir):
    """Names that swap, a target that another file keeps, and a file that isn't there."""
    where = folder(spark, "names")
    for k, name, _ in nations(spark, sf_dir):
        where.write(f"n{k}", name)
    done = where.renamed({"n0": "n1", "n1": "n0", "n2": "n9", "gone": "n77"})
    swapped = {n: where.read(n) for n in ("n0", "n1", "n2")}
    names = {f"n{k}": n for k, n, _ in nations(spark, sf_dir)}
    assert (swapped["n0"], swapped["n1"], swapped["n2"]) == (names["n1"], names["n0"], names["n2"])
    return spark.createDataFrame(sorted(done.items()), "old string, outcome string")


@register("run_states", "L3 B7 B21", """
SELECT r_regionkey, CASE WHEN r_regionkey%3=0 THEN 0 ELSE r_regionkey*10 END::BIGINT AS done, r_regionkey%3=0 AS kept_bad, 1::BIGINT AS versions FROM region""")
def run_states(spark, sf_dir):
    """States of runs, some corrupt: those begin afresh and the bad file stays beside; each is then saved with the old one kept."""
    where = folder(spark, "state")
    rows = [r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").limit(10).collect()]
    out = []
    for k in rows:
        name = f"run-{k}.json"
        where.write(name, '{"done": ' if k % 3 == 0 else json.dumps({"done": k * 10}))
        state = where.load_state(name, lambda: {"done": 0})
        where.save_state(name, state)
        where.backed_up(name, json.dumps(state | {"last": True}), "20240101")
        out.append((k, state["done"], f"{name}.bad" in where.names(), sum(n.startswith(f"{name}.2") for n in where.names())))
    return spark.createDataFrame(out, "r_regionkey long, done long, kept_bad boolean, versions long")


@register("audit_log", "B7 L5", """
WITH l AS (SELECT event_id, ts FROM events WHERE event_id%10<>3 UNION ALL SELECT -1-n_nationkey, TIMESTAMP '2030-01-01' FROM nation) SELECT event_id FROM l ORDER BY ts DESC, event_id DESC LIMIT 300""")
def audit_log(spark, sf_dir):
    """A log of JSON lines, appended to, of which the last 300 entries stay; lines that can't be read don't count."""
    path = f"{work_folder(spark, 'audit')}/log"
    line = F.when(F.col("event_id") % 10 == 3, "{broken").otherwise(F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"))))
    table(spark, sf_dir, "events").select(line).write.text(path)
    table(spark, sf_dir, "nation").select(F.to_json(F.struct((-1 - F.col("n_nationkey")).cast("long").alias("event_id"), L("2030-01-01 00:00:00").alias("ts")))).write.mode("append").text(path)
    entries = spark.read.text(path).select(F.from_json("value", "event_id long, ts timestamp_ntz").alias("e")).select("e.*").filter("event_id is not null and ts is not null")
    return entries.orderBy(F.desc("ts"), F.desc("event_id")).limit(300).select("event_id")


@register("sitemap", "B3 A5 H5", """
WITH r AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id)-1 AS k FROM pages WHERE NOT contains(url,'#'))
SELECT (k//100)::INT AS file, '<urlset>'||string_agg('<url><loc>'||replace(url,'&','&amp;')||'</loc></url>','' ORDER BY page_id)||'</urlset>' AS xml, count(*) AS n FROM r GROUP BY 1""")
def sitemap(spark, sf_dir):
    """Numbered files of at most ``size`` addresses, as the format has a limit; no task holds more than one file."""
    size = 100
    urls = table(spark, sf_dir, "pages").filter(~F.contains("url", L("#"))).select(F.col("page_id").cast("long").alias("page_id"), F.concat(L("<url><loc>"), t.html_escape(F.col("url")), L("</loc></url>")).alias("u"))
    placed = seq.global_number(urls, "page_id", ["u"], "at").withColumn("file", F.floor((F.col("at") - 1) / size).cast("int"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "u"))), lambda x: x["u"]), "")
    return placed.groupBy("file").agg(F.concat(L("<urlset>"), listed, L("</urlset>")).alias("xml"), F.count("*").alias("n"))


@register("head_tags", "B11 C37", """
SELECT page_id, CASE WHEN page_id%4=0 THEN 0 ELSE 2 END::BIGINT AS added, CASE WHEN page_id%4=0 THEN 'own' WHEN page_id%4=1 THEN 'lead '||page_id WHEN page_id%4=2 THEN 'first paragraph '||page_id ELSE 'title '||page_id END AS description FROM pages""")
def head_tags(spark, sf_dir):
    """Head tags that a page lacks, and no others; its description is its own, else the lead, the first paragraph or the title."""
    k = F.col("page_id") % 4
    n = F.col("page_id").cast("string")
    head = F.when(k == 0, '<meta content="own" name="description"><link rel="canonical" href="u"><meta property="og:title" content="t">').otherwise('<link rel="canonical" href="u">')
    body = F.when(k == 1, F.concat(L('<p class="lead">lead '), n, L("</p>"))).when(k == 2, F.concat(L("<p>first paragraph "), n, L("</p>"))).otherwise("")
    html = F.concat(L("<html><head><title>title "), n, L("</title>"), head, L("</head><body>"), body, L("</body></html>"))
    first = lambda p: F.nullif(F.regexp_extract(html, p, 1), L(""))
    given = F.coalesce(first(r'<meta[^>]*content="([^"]*)"[^>]*name="description"'), first(r'<meta[^>]*name="description"[^>]*content="([^"]*)"'))
    described = F.coalesce(given, first(r'<p class="lead">([^<]*)</p>'), first(r"<p>([^<]*)</p>"), first(r"<title>([^<]*)</title>"))
    lacking = F.filter(F.array(L('rel="canonical"'), L('name="description"'), L('property="og:title"')), lambda x: ~F.contains(html, x))
    return table(spark, sf_dir, "pages").select("page_id", F.size(lacking).cast("long").alias("added"), described.alias("description"))


@register("search_index", "B12 DM21 A5", r"""
WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id%6<>5), w AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(lower(text),'[a-zà-ÿ0-9]+'), ['doc'||doc_id])) AS term FROM d),
tf AS (SELECT term, doc_id, count(*) AS n FROM w GROUP BY 1,2), q AS (SELECT 'the' AS term UNION ALL SELECT 'doc'||doc_id FROM documents WHERE doc_id%100=0)
SELECT tf.term, doc_id, CASE WHEN tf.term='doc'||doc_id THEN 10 ELSE 1 END*n AS weight FROM tf JOIN q USING(term)""")
def search_index(spark, sf_dir):
    """An index that is wiped and built anew: pages that ask to be ignored are left out, an id's token weighs ten, and a term's
    documents are read by the partition of the term."""
    path = f"{work_folder(spark, 'index')}/terms"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 6 == 5, "<body data-search-ignore>").otherwise("<body>"), F.col("text")).alias("html"))
    words = docs.filter(~F.startswith("html", L("<body data-search-ignore"))).select("doc_id", F.explode(F.array_append(F.regexp_extract_all(F.lower(F.regexp_replace("html", "^<body[^>]*>", "")), L("[a-zà-ÿ0-9]+"), L(0)), F.concat(L("doc"), F.col("doc_id").cast("string")))).alias("term"))
    weight = F.when(F.col("term") == F.concat(L("doc"), F.col("doc_id").cast("string")), 10).otherwise(1)
    index = words.groupBy("term", "doc_id").agg(F.count("*").alias("n")).withColumn("weight", weight * F.col("n")).withColumn("part", F.pmod(F.hash("term"), L(16)))
    for _ in range(2):  # a second build replaces the first
        index.select("term", "doc_id", "weight", "part").write.mode("overwrite").partitionBy("part").parquet(path)
    asked = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select(F.concat(L("doc"), F.col("doc_id").cast("string")).alias("term"))
    asked = asked.unionByName(literal(spark, "(VALUES ('the')) AS t(term)")).withColumn("part", F.pmod(F.hash("term"), L(16)))
    return spark.read.parquet(path).join(asked, ["part", "term"]).select("term", "doc_id", "weight")


@register("stream_windowed_counts", "L3 L5", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1,2")
def stream_windowed_counts(spark, sf_dir):
    from quillspark.streaming import events

    return events.run_once(events.windowed(events.source(spark, sf_dir)))


@register("ordered_moves", "G7 G8 F17", """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)-1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
m AS (SELECT *, CASE WHEN o_orderkey%11=0 THEN 1 ELSE 0 END AS gone, CASE WHEN o_orderkey%7=0 THEN 1 ELSE 0 END AS tail FROM o)
SELECT o_orderkey, CASE WHEN gone=1 THEN NULL ELSE row_number() OVER (PARTITION BY o_custkey, gone ORDER BY tail, pos)-1 END AS place, CASE WHEN gone=1 THEN sum(1-gone) OVER (PARTITION BY o_custkey) END AS restored FROM m""")
def ordered_moves(spark, sf_dir):
    """Some articles of a section move to its tail, some are archived; places are dense, and what comes back goes behind the last."""
    w = Window.partitionBy("o_custkey")
    gone, tail = F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") % 7 == 0
    rows = table(spark, sf_dir, "orders").withColumn("gone", gone.cast("int")).withColumn("tail", tail.cast("int"))
    place = F.row_number().over(Window.partitionBy("o_custkey", "gone").orderBy("tail", "o_orderdate", "o_orderkey")) - 1
    left = F.sum(1 - F.col("gone")).over(w)
    return rows.select("o_orderkey", F.when(F.col("gone") == 0, place).cast("long").alias("place"), F.when(F.col("gone") == 1, left).alias("restored"))


@register("file_commits", "B6 B8 L7", """
SELECT 'a/'||n_nationkey||'.txt' AS name, CASE WHEN n_nationkey%3=0 THEN 'changed' ELSE n_name END AS text FROM nation WHERE n_nationkey%5<>4""")
def file_commits(spark, sf_dir):
    """Many files in one commit, then another that changes and deletes some; a commit on an old parent changes nothing."""
    where = folder(spark, "commits")
    rows = nations(spark, sf_dir)
    first = where.commit({f"a/{k}.txt": n for k, n, _ in rows}, None)
    second = where.commit({f"a/{k}.txt": None if k % 5 == 4 else "changed" for k, _, _ in rows if k % 5 == 4 or k % 3 == 0}, first)
    assert where.commit({"late.txt": "lost"}, first) is None and where.head() == second
    return spark.createDataFrame(sorted(where.committed(second).items()), "name string, text string")


@register("run_locks", "L4", """
SELECT r_regionkey, r_regionkey%4=0 AS taken, 'new' AS later FROM region""")
def run_locks(spark, sf_dir):
    """A lock whose owner lives is refused; one whose owner is gone, or that is too old, or its own, is taken; later all are."""
    where = folder(spark, "locks")
    rows = [r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").limit(10).collect()]
    out = []
    for k in rows:
        name = f"lock-{k}"
        assert where.lock(name, "old", 1000.0, lambda o: True)
        lives = k % 4 != 0
        taken = where.lock(name, "new", 1500.0, lambda o: lives)
        where.lock(name, "new", 9000.0, lambda o: True)
        out.append((k, taken, json.loads(where.read(name))["owner"]))
    return spark.createDataFrame(out, "r_regionkey long, taken boolean, later string")
