"""HTML text operators over pages, text audits and search over documents."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillspark.functions import text as t
from quillspark.plans.registry import register
from quillspark.sources.tables import literal, table

L = F.lit


@register("link_classify", "E5 A8 J10", """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html,'<a href="([^"]*)"',1)) AS href FROM pages), k AS (SELECT DISTINCT '/'||split_part(split_part(url,'/',4),'?',1) AS known FROM pages)
SELECT page_id, CASE WHEN href IN (SELECT known FROM k) THEN 'internal' WHEN href LIKE '/%' THEN 'broken' ELSE 'external' END AS kind, count(*) AS n FROM h GROUP BY 1,2""")
def link_classify(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", L('<a href="([^"]*)"'), L(1))).alias("href"))
    known = pages.select(F.concat(L("/"), F.split_part(F.split_part("url", L("/"), L(4)), L("?"), L(1))).alias("href")).distinct().withColumn("known", L(True))
    kind = F.when(F.col("known"), "internal").when(F.startswith("href", L("/")), "broken").otherwise("external")
    return links.join(known, "href", "left").groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@register("html_text_and_title", "C35 C36 A3 C47", r"""
WITH a AS (SELECT page_id, regexp_extract(html,'<title>(.*?)</title>',1) AS title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,'(?is)<script\b.*?</script\s*>',' ','g'),'(?is)<style\b.*?</style\s*>',' ','g'),'(?i)<br\s*/?>',chr(10),'g'),'<[^>]+>',' ','g') AS x FROM pages),
b AS (SELECT page_id, title, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x,'&nbsp;',' '),'&middot;','·'),'&copy;','©'),'&quot;','"'),'&lt;','<'),'&gt;','>'),'&amp;','&'),'[ \t]+',' ','g'),' *\n\s*',chr(10),'g')) AS plain FROM a)
SELECT page_id, title, md5(plain) AS plain, md5(left(plain,3500)) AS excerpt FROM b""")
def html_text_and_title(spark, sf_dir):
    plain = t.plain_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.md5(plain).alias("plain"), F.md5(F.left(plain, L(3500))).alias("excerpt"))


@register("meta_descriptions", "C37 B11", """
SELECT page_id, CASE WHEN page_id%3=0 THEN 'inserted' WHEN page_id%3=1 THEN 'has' ELSE 'empty' END AS state, count_tags FROM (SELECT page_id, CASE WHEN page_id%3=0 THEN 3 ELSE 2 END::BIGINT AS count_tags FROM pages)""")
def meta_descriptions(spark, sf_dir):
    meta = F.when(F.col("page_id") % 3 == 1, '<meta content="d" name="description">').when(F.col("page_id") % 3 == 2, "<meta name='description' content=''>").otherwise("")
    html = F.regexp_replace("html", "</head>", F.concat(meta, L("</head>")))
    tag = F.regexp_extract(html, r"""(?i)<meta\b[^>]*name=["']description["'][^>]*>""", 0)
    content = F.regexp_extract(tag, r"""(?i)content=["']([^"']*)["']""", 1)
    state = F.when(tag == "", "inserted").when(content == "", "empty").otherwise("has")
    wanted = (("canonical", r'rel="canonical"', '<link rel="canonical">'), ("og", "og:title", '<meta property="og:title">'), ("description", r"""(?i)name=["']description["']""", '<meta name="description">'))
    missing = F.array_compact(F.array(*(F.when(~html.rlike(pattern), add) for _, pattern, add in wanted)))
    return table(spark, sf_dir, "pages").select("page_id", state.alias("state"), F.size(missing).cast("long").alias("count_tags"))


@register("idempotent_injection", "B10 B20 B14", """
SELECT page_id, contains(html,'<body>') AS injected, length(html)+CASE WHEN contains(html,'<body>') THEN length('<!--id-->'||page_id||'<!--/id-->') ELSE 0 END AS size, true AS stable FROM pages""")
def idempotent_injection(spark, sf_dir):
    def inject(html):
        bare = F.regexp_replace(html, "<!--id-->.*?<!--/id-->", "")
        return F.replace(bare, L("<body>"), F.concat(L("<body><!--id-->"), F.col("page_id").cast("string"), L("<!--/id-->")))

    once = inject(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.contains("html", L("<body>")).alias("injected"), F.length(once).cast("long").alias("size"), (inject(once) == once).alias("stable"))


@register("first_images", "A8", """
SELECT page_id, CASE WHEN page_id%2=0 THEN 'https://x.example/p/'||page_id||'.jpg' END AS image FROM pages""")
def first_images(spark, sf_dir):
    key = F.col("page_id").cast("string")
    html = F.concat("html", L('<img src="data:x"><img src="/images/a.png"><img src="//y/b.svg">'), F.when(F.col("page_id") % 2 == 0, F.concat(L('<img src="/p/'), key, L('.jpg">'))).otherwise(""))
    found = F.filter(F.regexp_extract_all(html, L('<img src="([^"]+)"'), L(1)), lambda x: ~(F.startswith(x, L("data:")) | F.startswith(x, L("/images/")) | F.endswith(x, L(".svg"))))
    first = F.try_element_at(found, L(1))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.startswith(first, L("//")), F.concat(L("https:"), first)).when(F.startswith(first, L("/")), F.concat(L("https://x.example"), first)).otherwise(first).alias("image"))


@register("css_subjects", "J30 C40", """
SELECT page_id, len(regexp_extract_all(regexp_extract(html,'<style>(.*?)</style>',1),'[^{}]+[{]'))::BIGINT AS rules, regexp_extract(html,'<style>([a-z]+)',1) AS subject FROM pages""")
def css_subjects(spark, sf_dir):
    css = F.regexp_extract("html", "<style>(.*?)</style>", 1)
    selectors = F.filter(F.transform(F.split(css, r"\}"), lambda r: F.trim(F.substring_index(r, "{", 1))), lambda x: x != "")
    return table(spark, sf_dir, "pages").select("page_id", F.size(selectors).cast("long").alias("rules"), F.regexp_extract(F.try_element_at(selectors, L(1)), "([a-z]+)$", 1).alias("subject"))


@register("tile_scrape", "A14 A18", """
SELECT p_partkey, 'https://youtu.be/'||lpad(p_partkey::VARCHAR,11,'x') AS url, lpad(p_partkey::VARCHAR,11,'x') AS vid, p_name AS title FROM part""")
def tile_scrape(spark, sf_dir):
    vid = F.lpad(F.col("p_partkey").cast("string"), 11, "x")
    html = F.concat(L('<p>x</p><figure class="song"><a href="https://youtu.be/'), vid, L('"></a><figcaption>'), F.col("p_name"), L("</figcaption></figure>"))
    figures = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.regexp_extract_all(html, L('(?s)<figure class="song">.*?</figure>'), L(0))).alias("f"))
    url = F.regexp_extract("f", 'href="([^"]+)"', 1)
    return figures.select("p_partkey", url.alias("url"), t.video_id(url).alias("vid"), F.regexp_extract("f", "<figcaption>(.*?)</figcaption>", 1).alias("title"))


@register("note_numbers", "J37", """
SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN p_size WHEN p_partkey%3=1 THEN p_size+1 ELSE p_size+2 END::BIGINT AS number FROM part""")
def note_numbers(spark, sf_dir):
    n = lambda k: (F.col("p_size") + k).cast("string")
    html = F.when(F.col("p_partkey") % 3 == 0, F.concat(L('<li id="x9"><span class="n">'), n(0), L("</span>"))).when(F.col("p_partkey") % 3 == 1, F.concat(L('<li><a href="#ref-'), n(1), L('">'))).otherwise(F.concat(L('<li id="note-'), n(2), L('">')))
    part = lambda p: F.nullif(F.regexp_extract(html, p, 1), L("")).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(part('class="n">(\\d+)<'), part('href="#ref-(\\d+)"'), part('id="\\D*(\\d+)"')).alias("number"))


@register("block_skeletons", "C42 D6", r"""
SELECT doc_id, length(text)::BIGINT AS size, len(string_split(text,chr(10)))::BIGINT AS lines, left(text,80) AS head, right(text,40) AS tail, round(length(text)/len(string_split(text,chr(10))),2) AS line_size FROM documents""")
def block_skeletons(spark, sf_dir):
    lines = F.size(F.split("text", "\n", -1))
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("size"), lines.cast("long").alias("lines"), F.left("text", L(80)).alias("head"), F.right("text", L(40)).alias("tail"), F.round(F.length("text") / lines, 2).alias("line_size"))


@register("masked_equal", "J18", r"""
SELECT doc_id, regexp_replace(text,'\s+',' ','g') = regexp_replace(CASE WHEN doc_id%4=0 THEN text||'!' ELSE replace(text,' ','  ') END,'\s+',' ','g') AS same FROM documents""")
def masked_equal(spark, sf_dir):
    mask = lambda c: F.regexp_replace(F.regexp_replace(c, r"\[\^[^\]]+\]", ""), r"\s+", " ")
    other = F.when(F.col("doc_id") % 4 == 0, F.concat("text", L("!"))).otherwise(F.concat(F.replace("text", L(" "), L("  ")), L("[^1]")))
    return table(spark, sf_dir, "documents").select("doc_id", (mask(F.col("text")) == mask(other)).alias("same"))


def bm25(docs, queries, k1: float = 1.2, b: float = 0.75, top: int = 10, boosts: dict[str, float] | None = None):
    """(qid, doc_id, score, rank) of the best documents for each query.

    Terms are Latin words; a document meets a query by its terms (an equality join), and
    term statistics cover all documents.  ``boosts``: weights of single terms.
    """
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), L("[a-zà-ÿ0-9]+"), L(0))).alias("term"))
    asked = queries.select("qid", F.explode(F.split("query", " ")).alias("term")).distinct()
    sizes = docs.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), L("[a-zà-ÿ0-9]+"), L(0))).alias("size"))
    totals = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))  # one row
    tf = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(df, "term").join(sizes, "doc_id").crossJoin(F.broadcast(totals)).join(asked, "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = L(1.0)
    for term, value in (boosts or {}).items():
        weight = F.when(F.col("term") == term, value).otherwise(weight)
    gain = weight * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    scored = rows.groupBy("qid", "doc_id").agg(F.round(F.sum(gain), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return ranked.filter(F.col("rank") <= top)


_QUERIES = "(VALUES (1,'the of'),(2,'éai le'),(3,'thnt ere')) AS t(qid, query)"


@register("search_bm25_topk", "B12 DM21", f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text),'[a-zà-ÿ0-9]+') AS ws FROM documents), q AS (SELECT qid, unnest(string_split(query,' ')) AS term FROM {_QUERIES}),
n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w), e AS (SELECT doc_id, len(ws) AS size, unnest(ws) AS term FROM w), tf AS (SELECT term, doc_id, any_value(size) AS size, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY 1,2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT qid, doc_id, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*size/mean))),6) AS score FROM tf JOIN df USING(term) JOIN q USING(term), n GROUP BY 1,2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank<=10""")
def search_bm25_topk(spark, sf_dir):
    return bm25(table(spark, sf_dir, "documents"), literal(spark, _QUERIES))


@register("report_table", "B4 J34", """
SELECT n_regionkey, string_agg('| '||n_nationkey||' | '||replace(n_name,'|',chr(92)||'|')||' |', chr(10) ORDER BY n_nationkey) AS report FROM nation GROUP BY 1""")
def report_table(spark, sf_dir):
    line = F.concat(L("| "), F.col("n_nationkey").cast("string"), L(" | "), t.field_escape(F.col("n_name")), L(" |"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l"))))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(rows, lambda x: x["l"]), "\n").alias("report"))


@register("json_document", "B2 A2", """
SELECT n_regionkey, to_json(list({'key': n_nationkey, 'name': n_name} ORDER BY n_nationkey))::VARCHAR AS doc FROM nation GROUP BY 1""")
def json_document(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(rows).alias("doc"))


@register("template_fill", "J33 B16", "SELECT p_partkey, '<h1>'||p_name||'</h1><p>'||p_brand||'</p>' AS page FROM part")
def template_fill(spark, sf_dir):
    page = L("<h1>{{title}}</h1><p>{{body}}</p>")
    for name, column in (("title", "p_name"), ("body", "p_brand")):
        page = F.replace(page, L("{{" + name + "}}"), F.col(column))
    return table(spark, sf_dir, "part").select("p_partkey", page.alias("page"))


@register("windowed_events", "L5 P", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1,2""")
def windowed_events(spark, sf_dir):
    hour = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(hour.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
