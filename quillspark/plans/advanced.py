"""Operators over single texts (Arrow UDFs), similarity, verse, conversion, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import convert, edits as e, similarity as sim
from quillspark.plans.registry import register
from quillspark.sources import files
from quillspark.sources.tables import table

L = F.lit


@register("citation_compare", "E13 J19", """
SELECT item_id, CASE WHEN item_id%4=0 THEN 'match' WHEN item_id%4=1 THEN 'NO_SOURCE' WHEN item_id%4=2 THEN 'short' ELSE 'diff' END AS state FROM benchmark""")
def citation_compare(spark, sf_dir):
    k = F.col("item_id")
    quote = F.when(k % 4 == 2, F.left("text", L(20))).otherwise(F.col("text"))  # a short quote is short on purpose
    source = F.when(k % 4 == 0, F.upper("text")).when(k % 4 == 3, F.reverse("text")).when(k % 4 == 2, F.left("text", L(20)))
    return table(spark, sf_dir, "benchmark").select("item_id", sim.citation_state(quote, source).alias("state"))


@register("span_edits", "B9 DM17 E6", """
SELECT doc_id, CASE WHEN length(text)>=10 THEN 'AB'||text[3:4]||'XY'||text[7:] ELSE text END AS edited, CASE WHEN length(text)>=10 THEN 2 ELSE 0 END AS applied FROM documents""")
def span_edits(spark, sf_dir):
    edit = lambda a, b, s: F.struct(L(a).alias("start"), L(b).alias("end"), L(s).alias("text"))
    edits = F.when(F.length("text") >= 10, F.array(edit(0, 2, "AB"), edit(4, 6, "XY"), edit(3, 5, "no"))).otherwise(F.array().cast(e.EDIT))
    return table(spark, sf_dir, "documents").select("doc_id", e.edited(F.col("text"), edits).alias("r")).select("doc_id", F.col("r.text").alias("edited"), "r.applied")


@register("balanced_json", "J20 D13", "SELECT event_id, props AS found FROM events")
def balanced_json(spark, sf_dir):
    noisy = F.concat(L("text {not json} "), F.col("props"), L(" more {}"))
    return table(spark, sf_dir, "events").select("event_id", e.first_json(noisy).alias("found"))


@register("elided_diffs", "J19", """
SELECT p_partkey, CASE WHEN length(p_name)>0 THEN '…'||repeat('a',45)||p_name||repeat('b',45)||'…' END AS a FROM part""")
def elided_diffs(spark, sf_dir):
    wrap = lambda c: F.concat(F.repeat(L("a"), L(60)), c, F.repeat(L("b"), L(60)))
    return table(spark, sf_dir, "part").select("p_partkey", e.elided(wrap(F.col("p_name")), wrap(F.concat(L("#"), F.reverse("p_name"), L("#")))).alias("r")).select("p_partkey", F.col("r.a").alias("a"))


@register("html_tree_counts", "C22 DM15 D14", """
SELECT page_id, len(regexp_extract_all(html,'<li>'))::BIGINT AS li, len(regexp_extract_all(html,'<a '))::BIGINT AS a, len(regexp_extract_all(html,'<h1>'))::BIGINT AS h1 FROM pages""")
def html_tree_counts(spark, sf_dir):
    nodes = table(spark, sf_dir, "pages").select("page_id", F.explode(e.html_nodes("html")).alias("n"))
    of = lambda tag: F.count_if(F.col("n.tag") == tag).alias(tag)
    return nodes.groupBy("page_id").agg(of("li"), of("a"), of("h1"))


_TOP = '<a class="back-to-toc" href="#article-title" title="К началу статьи">↑</a>'
_BACK = 'title="Вернуться к месту в тексте">↑</a> '


@register("render_documents", "B1 J7 J8 M1 M2 M3 E16", f"""
SELECT p_partkey, '<h2 id="s1">'||p_name||' {_TOP}</h2>'||chr(10)||'<p>see <a class="internal" href="A1.html">T</a> <em>'||p_type||'</em><sup id="cite_ref-1"><a href="#cite_note-1">[1]</a></sup> a &lt; b<br>'||chr(10)||'<a class="broken" href="#">[[B2]]</a></p>'||chr(10)
 ||'<h2 id="notes">Примечания {_TOP}</h2>'||chr(10)||'<ol class="notes">'||chr(10)||'<li id="cite_note-1" value="1"><a class="backref" href="#cite_ref-1" {_BACK}'||p_brand||'</li>'||chr(10)||'</ol>' AS html, NULL::VARCHAR AS error FROM part""")
def render_documents(spark, sf_dir):
    src = F.concat(L("---\ntitle: x\n---\n\n## "), F.col("p_name"), L(" {s1}\n\nsee [[A1]] _"), F.col("p_type"), L("_[^1] a < b\n[[B2]]\n\n[^1]: "), F.col("p_brand"))
    render = convert.renderer(convert.Context(titles={"A1": "T"}))
    return table(spark, sf_dir, "part").select("p_partkey", render(src).alias("r")).select("p_partkey", "r.html", "r.error")


@register("render_inline", "J7 J8 E1 E2 E25 J39 A20", """
SELECT s_suppkey, '<p><a class="reference" href="http://b/c1/00'||(s_suppkey%4+1)||'.html">Book, chapter one, '||n_name||'</a> '
 ||CASE WHEN s_suppkey%3=0 THEN '<a class="reference" href="http://b/c1/001.html#p9">Book, chapter one, ' || (SELECT n_name FROM nation WHERE n_nationkey=1) || ', § 9</a>' ELSE '<a class="broken" href="#">{c1||'||(s_suppkey%3)||'}</a>' END
 ||' <a class="reference" href="http://b/c1/">Book, chapter one</a> <span class="leit">'||s_name||'</span> <a href="http://x" target="_blank" rel="noopener">http://x</a> <span class="glyph">;::))</span> <span class="spoiler"><span class="spoiler-content"><em>h</em></span></span> snake_case_'||s_suppkey||'</p>' AS html
FROM supplier JOIN nation ON n_nationkey=s_suppkey%4+1""")
def render_inline(spark, sf_dir):
    """References to an article, to a paragraph whose article the index knows, to a chapter; then the later passes."""
    known = [r for r in table(spark, sf_dir, "nation").filter("n_nationkey between 1 and 4").select("n_nationkey", "n_name").collect()]  # four rows of the index
    context = convert.Context(chapters={"c1": "chapter one"}, articles={f"c1/{r[0]}": r[1] for r in known}, paragraphs={"c1/9": "1"}, base="http://b", book="Book")
    k, number = F.col("s_suppkey"), (F.col("s_suppkey") % 4 + 1).cast("string")
    para = F.when(k % 3 == 0, "9").otherwise((k % 3).cast("string"))
    src = F.concat(L("{c1|"), number, L("} {c1||"), para, L("} {c1|} {leit|"), F.col("s_name"), L("} [http://x] ;::)) [spl]_h_[/spl] snake_case_"), k.cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", convert.renderer(context)(src)["html"].alias("html"))


@register("render_groups", "E17 E16 E18 C5 C6 G9", f"""
SELECT n_nationkey, '<p>a<sup id="cite_ref-g-1"><a href="#cite_note-g-1">¤1</a></sup> b<sup id="cite_ref-g-1-extra1"><a href="#cite_note-g-1">¤1</a></sup><sup id="cite_ref-star2"><a href="#cite_note-star2">**</a></sup></p>'||chr(10)
 ||'<ol class="notes">'||chr(10)||'<li class="anon" id="cite_note-g-1"><a class="backref" href="#cite_ref-g-1" {_BACK}¤1 '||n_name||'</li>'||chr(10)||'</ol>'||chr(10)||'<!-- orphan-refs group="g" -->'||chr(10)||'<!-- orphan-refs group="none" -->'||chr(10)
 ||'<h2 id="notes">Links {_TOP}</h2>'||chr(10)||'<ol class="notes">'||chr(10)||'<li id="cite_note-7" value="7">never asked<br>'||chr(10)||'second line</li>'||chr(10)||'<li class="anon" id="cite_note-star2"><a class="backref" href="#cite_ref-star2" {_BACK}** stars</li>'||chr(10)
 ||'<li class="anon anon-bare">bare</li>'||chr(10)||'<li class="anon">См. также: '||n_regionkey||'</li>'||chr(10)||'</ol>' AS html FROM nation""")
def render_groups(spark, sf_dir):
    """Notes of a group stand once, where their mark is; a mark repeated or without notes is flagged; the rest stands at the end."""
    src = F.concat(L("---\nnotes_title: Links\n---\na[^g.1] b[^g.1][^**]\n\n[refs=g glyph=¤]\n\n[refs=g]\n\n[refs=none]\n\n[^g.1]: "), F.col("n_name"), L("\n[^7]: never asked\n    second line\n[^**]: stars\n[^]: bare\n[^|См. также]: "), F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", convert.renderer(convert.Context())(src)["html"].alias("html"))


@register("render_contents", "G14 C7 B16", f"""
SELECT n_nationkey, '<details class="article-toc nonum"><summary>Содержание</summary><ol><li><a href="#first">First</a><ol><li><a href="#s'||n_nationkey||'">'||n_name||'</a></li><li><a href="#deep-two">Deep two</a></li></ol></li><li><a href="#last-one">Last one</a></li></ol></details>'||chr(10)
 ||'<h2 id="first">First {_TOP}</h2>'||chr(10)||'<h3 id="s'||n_nationkey||'">'||n_name||' {_TOP}</h3>'||chr(10)||'<h3 id="deep-two">Deep two {_TOP}</h3>'||chr(10)||'<h2 id="last-one">Last one {_TOP}</h2>' AS html, 4 AS headings FROM nation""")
def render_contents(spark, sf_dir):
    src = F.concat(L("[toc collapsed nonum]\n\n## First\n\n### "), F.col("n_name"), L(" {s"), F.col("n_nationkey").cast("string"), L("}\n\n### Deep two\n\n## Last one\n\n[toc]"))
    return table(spark, sf_dir, "nation").select("n_nationkey", convert.renderer(convert.Context())(src).alias("r")).select("n_nationkey", "r.html", "r.headings")


@register("render_verse_blocks", "C19 C21 G15 C11 G13", """
WITH w AS (SELECT p_partkey, upper(p_name[1])||p_name[2:] AS cap, p_name, p_name[1] AS c, p_name[2:] AS t, p_partkey%2=0 AS shown FROM part)
SELECT p_partkey, CASE WHEN shown THEN '<div class="faw"><div class="faw-p"><span class="faw-l a"><span class="faw-cap">'||c||'</span>'||t||'</span>'||chr(10)||'<span class="faw-l b faw-se"><span class="faw-cap">t</span>wo [x|y]</span>'||chr(10)||'<span class="faw-l a"><span class="faw-cap">t</span>hree</span></div></div>'
 ELSE '<p>'||p_name||' two [x|y] three</p>' END||chr(10)||'<div class="poem">'||CASE WHEN shown THEN '<span class="sb">Да будет свет'||chr(10)||'И стало так</span>'||chr(10)||'строка' ELSE 'ДА БУДЕТ СВЕТ'||chr(10)||'И СТАЛО ТАК'||chr(10)||'строка' END||'</div>' AS html FROM w""")
def render_verse_blocks(spark, sf_dir):
    """Free verse is lines in turn where the document switches it on, else prose; capitals fold where switched on."""
    shown = F.col("p_partkey") % 2 == 0
    front = F.when(shown, "---\ncaps: да\nallow_faw: on\n---\n").otherwise("---\ncaps: no\n---\n")
    src = F.concat(front, L("[faw sta=2]\n"), F.col("p_name"), L(" | two [x|y] |  three\n[/faw]\n\n[poem]\nДА БУДЕТ СВЕТ\nИ СТАЛО ТАК\nстрока\n[/poem]"))
    return table(spark, sf_dir, "part").select("p_partkey", convert.renderer(convert.Context())(src)["html"].alias("html"))


@register("render_failures", "B1 L8", "SELECT p_partkey, p_partkey%4=0 AS failed FROM part")
def render_failures(spark, sf_dir):
    """A document whose note has no end of numbers fails by itself: it has an error and no HTML, the others go on."""
    body = F.when(F.col("p_partkey") % 4 == 0, F.concat(L("a[^"), F.repeat(L("9"), L(5000)), L("]"))).otherwise(F.col("p_name"))
    done = table(spark, sf_dir, "part").select("p_partkey", convert.renderer(convert.Context())(body).alias("r"))
    return done.select("p_partkey", (F.col("r.error").isNotNull() & F.col("r.html").isNull()).alias("failed"))


@register("fold_capitals", "J6 D5 D8", """
SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN '<span class="sb">'||s||' будет <b>Роза</b> мира. И '||n||' стало</span>' WHEN s_suppkey%3=1 THEN 'Обычная строка '||s_name ELSE '<span class="sb">Свят Благословен Он царь</span>' END AS line
FROM (SELECT *, 'Да' AS s, s_suppkey::VARCHAR AS n FROM supplier)""")
def fold_capitals(spark, sf_dir):
    k = F.col("s_suppkey")
    line = F.when(k % 3 == 0, F.concat(L("ДА БУДЕТ <b>РОЗА</b> МИРА. И "), k.cast("string"), L(" СТАЛО"))).when(k % 3 == 1, F.concat(L("^ОБЫЧНАЯ строка "), F.col("s_name"))).otherwise("СВЯТ БЛАГОСЛОВЕН ОН ЦАРЬ")
    folded = F.udf(lambda s: convert.capitals(s, frozenset({"РОЗА"})), "string", useArrow=True)
    return table(spark, sf_dir, "supplier").select("s_suppkey", folded(line).alias("line"))


@register("markdown_reports", "B5", "SELECT n_nationkey, '<h2>'||n_name||'</h2>'||chr(10)||'<ul><li><b>'||n_regionkey||'</b></li><li>x</li></ul>'||chr(10)||'<table><tr><td>a|b</td><td>c</td></tr></table>' AS html FROM nation")
def markdown_reports(spark, sf_dir):
    src = F.concat(L("## "), F.col("n_name"), L("\n- **"), F.col("n_regionkey").cast("string"), L("**\n- x\n| a\\|b | c |\n|---|---|"))
    return table(spark, sf_dir, "nation").select("n_nationkey", convert.markdown_html(src).alias("html"))


@register("publish_only_changes", "B13 B14 B21", "SELECT p_partkey FROM part WHERE p_partkey%4=0 OR p_partkey%10=9")
def publish_only_changes(spark, sf_dir):
    new = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    old = new.filter("p_partkey % 10 <> 9").withColumn("p_name", F.when(F.col("p_partkey") % 4 == 0, "old").otherwise(F.col("p_name")))
    return files.publish_changed(new, old, "p_partkey").select("p_partkey")


