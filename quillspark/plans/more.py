"""Harvests and small text forms: notes, tracks, terms, node contexts, see-also lines, patterns."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillspark.functions import markup as m, text as t
from quillspark.operators import edits as e, importer
from quillspark.plans.registry import register
from quillspark.sources.tables import table

L = F.lit


def cat(*parts):
    return F.concat(*(p if not isinstance(p, str) else L(p) for p in parts))


def s(c):
    return F.col(c).cast("string")


@register("xml_works", "A4", "SELECT p_partkey, 'http://x/'||p_partkey AS url, p_name AS link FROM part")
def xml_works(spark, sf_dir):
    xml = cat('<work url="http://x/', s("p_partkey"), '" link="', F.col("p_name"), '"/>')
    row = F.from_xml(xml, "_url string, _link string")
    return table(spark, sf_dir, "part").select("p_partkey", row.alias("w")).select("p_partkey", F.col("w._url").alias("url"), F.col("w._link").alias("link"))


@register("harvest_notes", "C25 E18 J37 J35", """
SELECT s_suppkey, unnest([0,1,2]) AS pos, unnest(['s1','s1','s2']) AS grp, unnest([s_nationkey, s_nationkey+1, 7])::BIGINT AS id, unnest(['¤',NULL,NULL]) AS glyph, unnest([s_name,'see _it_','last']) AS body FROM supplier""")
def harvest_notes(spark, sf_dir):
    html = cat(
        '<section class="notes"><ol><li id="x1"><span class="num">¤', s("s_nationkey"), "</span> ", F.col("s_name"), '</li><li><a href="#ref-', (F.col("s_nationkey") + 1).cast("string"),
        '">^</a> see <em>it</em></li></ol></section><p>text</p><div class="footnotes"><ul><li id="note-7">last</li></ul></div>',
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(importer.harvest_notes(html)).alias("n")).select("s_suppkey", "n.*")


@register("term_candidates", "C53", """
SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN p_name WHEN p_partkey%3=1 THEN p_brand END AS term, CASE WHEN p_partkey%3=0 THEN 'dash' WHEN p_partkey%3=1 THEN 'run-in' ELSE 'grey' END AS rule FROM part""")
def term_candidates(spark, sf_dir):
    k = F.col("p_partkey") % 3
    item = F.when(k == 0, cat("<li><b>", F.col("p_name"), "</b> — text</li>")).when(k == 1, cat("<li><b>", F.col("p_brand"), ".</b> text</li>")).otherwise("<li>plain <b>x</b></li>")
    dash = F.nullif(F.regexp_extract(item, r"<li>\s*<b>([^<]+)</b>\s*[—–-]\s", 1), L(""))
    run_in = F.nullif(F.regexp_extract(item, r"<li>\s*<b>([^<]{1,60})\.</b>", 1), L(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(dash, run_in).alias("term"), F.when(dash.isNotNull(), "dash").when(run_in.isNotNull(), "run-in").otherwise("grey").alias("rule"))


@register("node_contexts", "C54 C50", """
SELECT n_nationkey, unnest(['h2','p']) AS before, unnest([n_name, n_name]) AS heading, unnest([true,false]) AS kept FROM nation""")
def node_contexts(spark, sf_dir):
    html = cat("<div><h2>", F.col("n_name"), "</h2><p>first</p><p>second</p></div>")
    nodes = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(e.html_nodes(html)).alias("n")).select("n_nationkey", "n.*")
    text = nodes.filter("tag = '#text'").select("n_nationkey", F.col("parent").alias("id"), F.col("text").alias("said"))
    tags = nodes.filter("tag <> '#text'").drop("text").join(text, ["n_nationkey", "id"], "left")
    siblings = Window.partitionBy("n_nationkey", "parent").orderBy("id")
    w = Window.partitionBy("n_nationkey").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    seen = tags.withColumn("before", F.lag("tag").over(siblings)).withColumn("heading", F.last(F.when(F.col("tag") == "h2", F.col("said")), ignorenulls=True).over(w))
    return seen.filter("tag = 'p'").select("n_nationkey", "before", "heading", F.contains(L("the first one"), F.left("said", L(25))).alias("kept"))


@register("see_also_links", "C32 I6", "SELECT s_suppkey, unnest([s_name, 'two']) AS label, unnest(['a/'||s_suppkey, 'b']) AS href FROM supplier")
def see_also_links(spark, sf_dir):
    line = cat("См. также:  [a/", s("s_suppkey"), "|", F.col("s_name"), "] ;; [b|two]. ")
    bare = F.regexp_replace(F.regexp_replace(line, r"^\s*См\.\s*также\s*:?\s*", ""), r"[\s;.,]+$", "")
    links = F.regexp_extract_all(bare, L(r"\[([^\]]+)\]"), L(1))
    found = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(links).alias("x"))
    return found.select("s_suppkey", F.substring_index("x", "|", -1).alias("label"), F.substring_index("x", "|", 1).alias("href"))


@register("first_token_labels", "G24", """
SELECT p_partkey, unnest(range(0, len(string_split(p_name,' '))))::INT AS pos, unnest(string_split(p_name,' ')) AS token, unnest(list_transform(range(0, len(string_split(p_name,' '))), lambda i: CASE WHEN i=0 THEN p_brand END)) AS label FROM part""")
def first_token_labels(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.posexplode(F.split("p_name", " ")).alias("pos", "token"))
    return tokens.select("p_partkey", "pos", "token", F.when(F.col("pos") == 0, F.col("p_brand")).alias("label"))


@register("built_pages", "D17", "SELECT page_id, contains(html,'<article') AND contains(html,'</html>') AS built FROM pages")
def built_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.contains("html", L("<article")) & F.contains("html", L("</html>"))).alias("built"))


def title_pattern(title):
    """A pattern for a title in running text: long words by stem and any ending, anything but letters between."""
    words = F.filter(F.split(title, r"[\s\p{Punct}]+"), lambda w: w != "")
    one = lambda w: F.when(F.length(w) >= 5, F.concat(F.left(w, F.length(w) - 2), L("[a-zа-яё]*"))).otherwise(w)
    return F.concat(L("(?i)"), F.array_join(F.transform(words, one), r"[^0-9A-Za-zА-Яа-яЁё]*"))


@register("dry_run_and_apply", "B14 M6", "SELECT 'changed' AS outcome, count(*) AS n FROM part WHERE p_size>25 UNION ALL SELECT 'unchanged', count(*) FROM part WHERE p_size<=25")
def dry_run_and_apply(spark, sf_dir):
    new = F.when(F.col("p_size") > 25, t.html_escape(cat(F.col("p_name"), "&"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").groupBy(F.when(new != F.col("p_name"), "changed").otherwise("unchanged").alias("outcome")).agg(F.count("*").alias("n"))


@register("note_marker_round_trip", "C2 C3 E27", "SELECT p_partkey, p_name||'[^1]' AS title FROM part")
def note_marker_round_trip(spark, sf_dir):
    src = m.set_field(L("---\ntitle: x[^1]\n---\nbody"), "title", F.concat(F.col("p_name"), F.array_join(t.marks(L("x[^1]")), "")))
    return table(spark, sf_dir, "part").select("p_partkey", m.frontmatter(src)["title"].alias("title"))


@register("trailing_elements", "J31 D12", "SELECT n_nationkey, 'div' AS last_tag, '<div id='||n_nationkey||'>z</div>' AS tail FROM nation")
def trailing_elements(spark, sf_dir):
    html = cat("<p>a</p><div id=", s("n_nationkey"), ">z</div>\n")
    nodes = table(spark, sf_dir, "nation").select("n_nationkey", html.alias("html"), e.html_nodes(html).alias("n"))
    tops = F.filter("n", lambda x: x["parent"].isNull() & (x["tag"] != "#text"))
    last = F.try_element_at(tops, L(-1))["tag"]
    return nodes.select("n_nationkey", last.alias("last_tag"), F.regexp_extract("html", r"(<div\b[^>]*>[^<]*</div>)\s*$", 1).alias("tail"))


@register("relink_actions", "E6 B9 J29", """
SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN 'WRAP' WHEN p_partkey%3=1 THEN 'ANCHOR' ELSE 'REVIEW' END AS action FROM part""")
def relink_actions(spark, sf_dir):
    """A bare link gets the title before it wrapped where the title stands there (overlap of 0.55 or more),
    an anchored one only its target, the others are for review."""
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, cat("read ", F.col("p_name"), " https://x.y/1")).when(k == 1, cat("[https://x.y/1|", F.col("p_name"), "]")).otherwise(L("nothing like it https://x.y/1"))
    before = F.right(F.substring_index(line, "https://", 1), L(160))
    action = F.when(line.rlike(r"\[https?://[^|\]]+\|"), "ANCHOR").when(t.stem_overlap(F.col("p_name"), before) >= 0.55, "WRAP").otherwise("REVIEW")
    return table(spark, sf_dir, "part").select("p_partkey", action.alias("action"))
