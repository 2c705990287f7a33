"""Round trips: markup is built from table columns, parsed, and compared with the columns."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillspark.functions import markup as m, text as t
from quillspark.operators import joins, sequence as seq
from quillspark.plans.registry import register
from quillspark.sources.tables import table

L = F.lit


def cat(*parts):
    return F.concat(*(p if not isinstance(p, str) else L(p) for p in parts))


def s(c):
    return F.col(c).cast("string")


@register("frontmatter_roundtrip", "C1 C2 DM1 DM2 DM2b", """
SELECT c_custkey, c_name AS title, 'first' AS first_title, c_mktsegment AS kind, 'Body '||c_custkey AS body FROM customer""")
def frontmatter_roundtrip(spark, sf_dir):
    src = cat("---\ntitle: first\nkind: '", F.col("c_mktsegment"), "'\nnot a field\ntitle: \"", F.col("c_name"), "\"\n---\n\n\nBody ", s("c_custkey"))
    fm, first = m.frontmatter(src), m.frontmatter(src, first_wins=True)
    return table(spark, sf_dir, "customer").select("c_custkey", fm["title"].alias("title"), first["title"].alias("first_title"), fm["kind"].alias("kind"), m.body(src).alias("body"))


@register("set_frontmatter_fields", "C3 C48 C49 D18", """
SELECT s_suppkey, s_name AS title, s_name AS made, NULL::VARCHAR AS gone, 'old' AS kept FROM supplier""")
def set_frontmatter_fields(spark, sf_dir):
    src = L("---\ntitle: old\nkeep: old\ndrop: x\n---\ntext")
    changed = m.remove_field(m.set_field(src, "title", F.col("s_name")), "drop")
    made = m.set_field(L("text"), "title", F.col("s_name"))
    fm = m.frontmatter(changed)
    return table(spark, sf_dir, "supplier").select("s_suppkey", fm["title"].alias("title"), m.frontmatter(made)["title"].alias("made"), fm["drop"].alias("gone"), fm["keep"].alias("kept"))


def _body():
    return cat(
        "## Head ", F.col("p_name"), " {s", s("p_partkey"), "}\n[toc collapsed nonum]\n\npara ", F.col("p_brand"), "\nmore\n\n[poem title=\"", F.col("p_type"), "\" caps]\nx\n\ny\n[/poem]\n\n[sub]",
        s("p_size"), "[/sub]\n\n[refs=g glyph=*]\n\n[img=\"a.png\" cap=\"[u|v]\"]\n\n[epi]\nunclosed ", s("p_partkey"),
    )


@register("blocks_roundtrip", "C7 C8 C9 C20 C46 DM3 DM4 M3", """
SELECT p_partkey, 0 AS pos, 'heading' AS type, 'Head '||p_name AS text, 's'||p_partkey AS extra FROM part UNION ALL SELECT p_partkey, 1, 'toc', NULL, 'true' FROM part
UNION ALL SELECT p_partkey, 2, 'paragraph', 'para '||p_brand||chr(10)||'more', NULL FROM part UNION ALL SELECT p_partkey, 3, 'poem', 'x'||chr(10)||chr(10)||'y', p_type FROM part
UNION ALL SELECT p_partkey, 4, 'sub', p_size::VARCHAR, NULL FROM part UNION ALL SELECT p_partkey, 5, 'refs', NULL, 'g' FROM part UNION ALL SELECT p_partkey, 6, 'img', NULL, '[u|v]' FROM part
UNION ALL SELECT p_partkey, 7, 'paragraph', '[epi]'||chr(10)||'unclosed '||p_partkey, NULL FROM part""")
def blocks_roundtrip(spark, sf_dir):
    parsed = table(spark, sf_dir, "part").select("p_partkey", m.parse_document(_body()).alias("d")).select("p_partkey", F.explode("d.blocks").alias("b"))
    extra = F.coalesce("b.slug", F.col("b.attrs")["collapsed"], F.col("b.attrs")["title"], "b.grp", F.col("b.attrs")["cap"])
    return parsed.select("p_partkey", "b.pos", "b.type", F.coalesce("b.text", "b.inner").alias("text"), extra.alias("extra"))


@register("notes_roundtrip", "C5 C6 DM5 E17 I6", """
SELECT s_suppkey, 0 AS pos, 'numbered' AS kind, s_nationkey::BIGINT AS id, NULL AS label, s_name||chr(10)||'b' AS body FROM supplier UNION ALL SELECT s_suppkey, 1, 'numbered', 2, 'g', 'c' FROM supplier
UNION ALL SELECT s_suppkey, 2, 'starred', NULL, '*', 'd' FROM supplier UNION ALL SELECT s_suppkey, 3, 'anon', NULL, NULL, 'e' FROM supplier UNION ALL SELECT s_suppkey, 4, 'anon', NULL, '', 'f' FROM supplier
UNION ALL SELECT s_suppkey, 5, 'anon', NULL, 'See', 'h' FROM supplier UNION ALL SELECT s_suppkey, 6, 'starred', NULL, '**', 'i' FROM supplier""")
def notes_roundtrip(spark, sf_dir):
    src = cat("text\n\n[^", s("s_nationkey"), "]: ", F.col("s_name"), "\n    b\n\n[^g.2]: c\n[^*]: d\n[^]: e\n[^|]: f\n[^|See]: h\n[^|**]: i\n\n")
    parsed = table(spark, sf_dir, "supplier").select("s_suppkey", m.parse_document(src).alias("d")).select("s_suppkey", F.explode("d.notes").alias("n"))
    return parsed.select("s_suppkey", "n.pos", "n.kind", "n.id", F.coalesce("n.grp", "n.star", "n.prefix").alias("label"), "n.body")


def _noted(spark, sf_dir):
    """(key, text, defs): documents that mark notes, some twice, and define some that nobody marks."""
    key = F.col("p_partkey")
    text = cat("x[^", s("p_size"), "] y[^", s("p_size"), "] z[^g.2]", F.when(key % 3 == 0, "[^**]").otherwise(""))
    defs = F.array(s("p_size"), F.when(key % 2 == 0, "g-2").otherwise("99"), L("star2"))
    return table(spark, sf_dir, "part").select(key.alias("art"), text.alias("text"), defs.alias("defs"))


@register("note_markers", "DM6 G9 E16", """
WITH m AS (SELECT p_partkey AS art, unnest(range(0,CASE WHEN p_partkey%3=0 THEN 4 ELSE 3 END)) AS pos, unnest(list_concat([p_size::VARCHAR,p_size::VARCHAR,'g-2'],CASE WHEN p_partkey%3=0 THEN ['star2'] ELSE [] END)) AS key FROM part)
SELECT art, pos, key, key||CASE WHEN row_number() OVER w=1 THEN '' ELSE '-extra'||(row_number() OVER w-1) END AS anchor FROM m WINDOW w AS (PARTITION BY art, key ORDER BY pos)""")
def note_markers(spark, sf_dir):
    marks = _noted(spark, sf_dir).select("art", F.posexplode(m.note_markers(F.col("text"))).alias("pos", "key"))
    k = seq.occurrence(marks, ["art", "key"], ["pos"], "k")
    return k.select("art", F.col("pos").cast("long").alias("pos"), "key", F.concat("key", F.when(F.col("k") == 1, "").otherwise(F.concat(L("-extra"), (F.col("k") - 1).cast("string")))).alias("anchor"))


@register("notes_orphans", "E16 E17 C51", """
WITH m AS (SELECT DISTINCT p_partkey AS art, unnest(list_concat([p_size::VARCHAR,'g-2'],CASE WHEN p_partkey%3=0 THEN ['star2'] ELSE [] END)) AS key FROM part), d AS (SELECT p_partkey AS art, unnest([p_size::VARCHAR, CASE WHEN p_partkey%2=0 THEN 'g-2' ELSE '99' END, 'star2']) AS key FROM part)
SELECT art, key, 'orphan' AS state FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.art=d.art AND m.key=d.key) UNION ALL SELECT art, key, 'undefined' FROM m WHERE NOT EXISTS (SELECT 1 FROM d WHERE m.art=d.art AND m.key=d.key)""")
def notes_orphans(spark, sf_dir):
    docs = _noted(spark, sf_dir)
    marks = docs.select("art", F.explode(F.array_distinct(m.note_markers(F.col("text")))).alias("key"))
    defs = docs.select("art", F.explode("defs").alias("key"))
    return defs.join(marks, ["art", "key"], "left_anti").withColumn("state", L("orphan")).unionByName(marks.join(defs, ["art", "key"], "left_anti").withColumn("state", L("undefined")))


@register("link_orphan_report", "C1 C5 C7 E1 E16 F1", """
WITH r AS (SELECT s_suppkey AS art, unnest([(s_nationkey*7)%31, s_nationkey]) AS ref FROM supplier)
SELECT 'links' AS what, count(*) AS n, count(*) FILTER (ref NOT IN (SELECT n_nationkey FROM nation)) AS bad FROM r
UNION ALL SELECT 'notes', 2*count(*), count(*) FROM supplier UNION ALL SELECT 'heading', count(*), 0 FROM supplier UNION ALL SELECT 'paragraph', count(*), 0 FROM supplier""")
def link_orphan_report(spark, sf_dir):
    """Documents are built from suppliers, parsed once, and their links, notes and blocks audited in one pass:
    notes meet their markers inside the document, links meet their targets by a join."""
    src = cat("---\ntitle: ", F.col("s_name"), "\n---\n## ", F.col("s_name"), "\n\nsee [[", ((F.col("s_nationkey") * 7) % 31).cast("string"), "]] and [[", s("s_nationkey"), "]] x[^1]\n\n[^1]: a\n[^2]: b")
    docs = table(spark, sf_dir, "supplier").select(m.parse_document(m.body(src)).alias("d"))
    said = F.array_join(F.transform("d.blocks", lambda b: F.coalesce(b["text"], b["inner"], L(""))), "\n")
    docs = docs.select("d", m.link_ids(said).alias("refs"), m.note_markers(said).alias("marks"))
    row = lambda what, key, bad: F.struct(what.alias("what"), key.alias("key"), bad.alias("bad"))
    links = F.transform("refs", lambda x: row(L("links"), x, L(False)))
    notes = F.transform("d.notes", lambda n: row(L("notes"), L(None).cast("string"), ~F.array_contains("marks", n["id"].cast("string"))))
    kinds = F.transform("d.blocks", lambda b: row(b["type"], L(None).cast("string"), L(False)))
    rows = docs.select(F.explode(F.concat(links, notes, kinds)).alias("r")).select("r.*")
    titles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("title"))
    bad = F.when(F.col("what") == "links", F.col("broken")).otherwise(F.col("bad"))
    return joins.resolve(rows, titles, "key", "title").groupBy("what").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))


@register("broken_refs", "E1 C11 C7", """
SELECT s_suppkey, coalesce(n_name, '[['||((s_nationkey*7)%31)||']]') AS label, n_name IS NULL AS broken FROM supplier LEFT JOIN nation ON n_nationkey=(s_nationkey*7)%31""")
def broken_refs(spark, sf_dir):
    ref = m.link_ids(cat("a [[", ((F.col("s_nationkey") * 7) % 31).cast("string"), "]] b"))[0]
    refs = table(spark, sf_dir, "supplier").select("s_suppkey", ref.alias("ref"))
    titles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("ref"), F.col("n_name").alias("title"))
    return joins.resolve(refs, titles, "ref", "title").select("s_suppkey", F.coalesce("title", cat("[[", F.col("ref"), "]]")).alias("label"), "broken")


@register("toc_tree", "G14 G23 DM20", """
WITH h AS (SELECT o_custkey AS art, o_orderkey AS pos, CASE WHEN o_orderkey%3=0 THEN 2 ELSE 3 END AS level FROM orders)
SELECT art, pos, level, CASE WHEN level=3 THEN last_value(CASE WHEN level=2 THEN pos END IGNORE NULLS) OVER (PARTITION BY art ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS parent_pos,
 count(*) FILTER (level=2) OVER (PARTITION BY art) >= greatest(2, ceil(count(*) OVER (PARTITION BY art)/2)) AS nonum FROM h""")
def toc_tree(spark, sf_dir):
    heads = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("art"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(3).alias("level"))
    parents = seq.carry_forward(heads, ["art"], ["pos"], F.when(F.col("level") == 2, F.col("pos")), "up")
    w = Window.partitionBy("art")
    nonum = F.sum((F.col("level") == 2).cast("long")).over(w) >= F.greatest(L(2), F.ceil(F.count("*").over(w) / 2))
    return parents.select("art", "pos", "level", F.when(F.col("level") == 3, F.col("up")).alias("parent_pos"), nonum.alias("nonum"))


@register("dialog_segments", "C17 G11 DM3", """
SELECT conv_id, turn AS post_no, role AS label, 1::BIGINT AS n_bodies FROM conversations""")
def dialog_segments(spark, sf_dir):
    """Dialogues with explicit labels: paragraphs are cut out of one text and attached to their posts."""
    part = cat(">> ", F.col("role"), "\n", F.regexp_replace("text", r"\n\s*\n", "\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n\n")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("inner"))
    paras = talks.select("conv_id", F.posexplode(F.filter(F.split("inner", r"\n\s*\n"), lambda p: F.trim(p) != "")).alias("pos", "p"))
    label = F.when(F.col("p").rlike(r"^>>\s"), F.trim(F.substring_index(F.substring("p", 3, 1 << 30), "\n", 1)))
    posts = paras.withColumn("label", label).withColumn("post", F.sum(F.col("label").isNotNull().cast("long")).over(Window.partitionBy("conv_id").orderBy("pos")))
    grouped = posts.groupBy("conv_id", "post").agg(F.max("label").alias("label"), F.count("*").alias("n_bodies"))
    return grouped.select("conv_id", (F.col("post") - 1).alias("post_no"), "label", "n_bodies")


@register("tracks_roundtrip", "C12 C26 J26 DM7", """
SELECT p_partkey, CASE WHEN p_partkey%5=0 THEN 'noplayer' ELSE 'track' END AS kind, CASE WHEN p_partkey%5=0 THEN NULL ELSE 'https://youtu.be/x'||p_partkey END AS url, p_name AS title, p_brand AS author, p_size::BIGINT AS fn_num FROM part""")
def tracks_roundtrip(spark, sf_dir):
    url = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(cat("https://youtu.be/x", s("p_partkey")))
    line = cat(url, ", ", F.when(F.col("p_partkey") % 2 == 0, cat(s("p_size"), ") ")).otherwise(""), "▶ ", F.col("p_name"), ", ", F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 1, cat(", ", s("p_size"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", m.track(line).alias("t")).select("p_partkey", "t.*")


@register("tiles_roundtrip", "C13 B17 A19 DM8", """
SELECT p_partkey, lpad(p_partkey::VARCHAR, CASE WHEN p_partkey%4=0 THEN 10 ELSE 11 END, 'x') AS yt_id, replace(p_name,' ','|') AS title, 2::BIGINT AS n_links, p_partkey%4=0 AS broken FROM part""")
def tiles_roundtrip(spark, sf_dir):
    vid = F.when(F.col("p_partkey") % 4 == 0, F.lpad(s("p_partkey"), 10, "x")).otherwise(F.lpad(s("p_partkey"), 11, "x"))
    line = cat(vid, " | ", t.field_escape(F.replace("p_name", L(" "), L("|"))), " | ", F.col("p_brand"), " | a:one, b")
    return table(spark, sf_dir, "part").select("p_partkey", m.tile(line).alias("t")).select("p_partkey", "t.yt_id", "t.title", F.size("t.links").cast("long").alias("n_links"), (F.size("t.missing") > 0).alias("broken"))


@register("audio_rows_roundtrip", "C14 K7 DM9", """
SELECT o_orderkey, o_orderkey%6=0 AS broken, CASE WHEN o_orderkey%6<>0 THEN o_orderkey||'.mp3' END AS file, CASE WHEN o_orderkey%6<>0 THEN (o_orderkey%60)*60+(o_custkey%60) END AS dur_s, CASE WHEN o_orderkey%6<>0 THEN o_orderpriority||' | '||o_orderstatus END AS caption FROM orders""")
def audio_rows_roundtrip(spark, sf_dir):
    file = cat(s("o_orderkey"), F.when(F.col("o_orderkey") % 6 == 0, ".txt").otherwise(".mp3"))
    dur = F.format_string("%d:%02d", F.col("o_orderkey") % 60, F.col("o_custkey") % 60)
    line = cat(file, " | ", F.col("o_orderpriority"), " | ", dur, " | ", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", m.audio_row(line).alias("a")).select("o_orderkey", "a.*")


@register("numbered_lists_roundtrip", "C15 C50", """
SELECT s_suppkey, unnest([s_nationkey, s_nationkey+1, 90])::BIGINT AS num, unnest(['.','.',')']) AS style, unnest([s_name, 'free', 'last']) AS body FROM supplier""")
def numbered_lists_roundtrip(spark, sf_dir):
    inner = cat(s("s_nationkey"), ". ", F.col("s_name"), "\n\nfree\n\n90) last")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(m.numbered_items(inner)).alias("i")).select("s_suppkey", "i.*")


@register("bullets_and_cards_roundtrip", "C16 C18", """
SELECT s_suppkey, s_name||chr(10)||'more' AS first_item, 2::BIGINT AS n_items, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier""")
def bullets_and_cards_roundtrip(spark, sf_dir):
    items = m.bullets(cat("- ", F.col("s_name"), "\nmore\n- two"))
    card = m.card_rows(cat("Name: ", F.col("s_name"), "\nno label\nNation: ", s("s_nationkey")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", items[0].alias("first_item"), F.size(items).cast("long").alias("n_items"), card["Name"].alias("name"), card["Nation"].alias("nation"))


@register("top_level_split", "C11 C21", "SELECT p_partkey, 'a ' AS first, ' ['||p_name||'|x] ' AS middle, 3::BIGINT AS n FROM part")
def top_level_split(spark, sf_dir):
    parts = m.split_top(cat("a | [", F.col("p_name"), "|x] | b]"))
    return table(spark, sf_dir, "part").select("p_partkey", parts[0].alias("first"), parts[1].alias("middle"), F.size(parts).cast("long").alias("n"))


@register("title_variants", "C43 C3 J2", "SELECT p_partkey, p_name||'[^1]' AS heading, p_name AS plain, coalesce(nullif(trim(CASE WHEN p_size>25 THEN p_brand ELSE ' ' END),''), p_name) AS window_title FROM part")
def title_variants(spark, sf_dir):
    h = cat(F.col("p_name"), "[^1]")
    shown = F.coalesce(F.nullif(F.trim(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" ")), L("")), t.strip_marks(h))
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("heading"), t.strip_marks(h).alias("plain"), shown.alias("window_title"))


@register("image_tags", "C45", "SELECT p_partkey, p_partkey||'_'||(p_size+1)||'.png' AS next_file, 2::BIGINT AS n FROM part")
def image_tags(spark, sf_dir):
    src = cat("[img src=", s("p_partkey"), "_1.png]\n\n[img src=", s("p_partkey"), "_", s("p_size"), ".png cap=\"x\"]")
    numbers = F.transform(F.regexp_extract_all(src, L(r"\[img src=\d+_(\d+)\.png"), L(1)), lambda x: x.cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", cat(s("p_partkey"), "_", (F.array_max(numbers) + 1).cast("string"), ".png").alias("next_file"), F.size(numbers).cast("long").alias("n"))


@register("json_records", "J38 A2 A12 D13", """
SELECT event_id, CASE WHEN event_id%4=0 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN event_id%4<>0 THEN event_type END AS first_url FROM events""")
def json_records(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, "not json").otherwise(cat('[{"url":"', F.col("event_type"), '"},{"label":"x"}]'))
    rows = F.coalesce(F.filter(F.from_json(raw, "array<struct<url:string,label:string>>"), lambda x: x["url"].isNotNull()), F.array().cast("array<struct<url:string,label:string>>"))
    return table(spark, sf_dir, "events").select("event_id", F.size(rows).cast("long").alias("n"), F.try_element_at(rows, L(1))["url"].alias("first_url"))


@register("settings_sanitised", "C38", """
SELECT p_partkey, CASE WHEN p_size>25 THEN 'wide' ELSE 'narrow' END AS width, 1::BIGINT AS n_rules FROM part""")
def settings_sanitised(spark, sf_dir):
    raw = cat('{"global":{"width":"', F.when(F.col("p_size") > 25, "wide").otherwise("bogus"), '"},"rules":[{"kind":"type","value":"x"},{"kind":"bad"}]}')
    doc = F.from_json(raw, "global struct<width:string>, rules array<struct<kind:string,value:string>>")
    rules = F.slice(F.filter(doc["rules"], lambda r: r["kind"].isin("type", "section") & r["value"].isNotNull()), 1, 100)
    width = F.when(doc["global"]["width"].isin("wide", "narrow"), doc["global"]["width"]).otherwise("narrow")
    return table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), F.size(rules).cast("long").alias("n_rules"))


@register("override_blocks", "A11 A15", """
SELECT s_suppkey, unnest([0,1]) AS block, unnest([2,1])::BIGINT AS n_lines FROM supplier""")
def override_blocks(spark, sf_dir):
    src = cat(F.col("s_name"), "\nb\n \t\n\nc")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.split(src, r"\n[ \t]*\n+")).alias("block", "b")).select("s_suppkey", "block", F.size(F.split("b", "\n")).cast("long").alias("n_lines"))


@register("newline_normalise", "C4 C19", "SELECT doc_id, md5(text) AS same FROM documents")
def newline_normalise(spark, sf_dir):
    mixed = F.regexp_replace("text", "\n", "\r\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.newlines(mixed)).alias("same"))


@register("chapter_index", "A13 A22 F7 DM12", """
SELECT o_custkey AS ch, count(*) AS n_articles, min(o_orderkey) AS para_min, max(o_orderkey) AS para_max FROM orders GROUP BY 1""")
def chapter_index(spark, sf_dir):
    head = cat("§", s("o_orderkey"), ". title")
    para = F.regexp_extract(head, r"^§(\d+)\.", 1).cast("long")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ch")).agg(F.count("*").alias("n_articles"), F.min(para).alias("para_min"), F.max(para).alias("para_max"))
