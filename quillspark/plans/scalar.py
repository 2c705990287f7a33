"""Scalar functions over the tables: strings (J), dates (K), single-row predicates (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import dates as d, text as t
from quillspark.plans.registry import register
from quillspark.sources.tables import table

L = F.lit


def big(c):
    return c.cast("long")


@register("escape_markup", "J1 J34", """
SELECT page_id, md5(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;')) AS escaped,
 md5(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;')) AS attribute,
 md5(replace(html,'|',chr(92)||'|')) AS field FROM pages""")
def escape_markup(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.html_escape(h)).alias("escaped"), F.md5(t.attr_escape(h)).alias("attribute"), F.md5(t.field_escape(h)).alias("field"))


@register("capitalize_words", "J2", "SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS name, upper(p_type[1]) || lower(p_type[2:]) AS kind FROM part")
def capitalize_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.capitalize(F.col("p_name")).alias("name"), t.capitalize(F.col("p_type")).alias("kind"))


@register("plural_forms", "J4 F1", """
SELECT p_brand, n, CASE WHEN n%10=1 AND n%100<>11 THEN 'one' WHEN n%10 BETWEEN 2 AND 4 AND n%100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS form
FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)""")
def plural_forms(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("form", t.plural(F.col("n"), "one", "few", "many"))


@register("dotted_dates", "J5", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS dotted FROM orders")
def dotted_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", d.dotted(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dotted"))


@register("normalize_urls", "J10 J15", """
SELECT page_id, replace(rtrim(lower(trim(url)),'/'),'http://','https://') AS plain,
 rtrim(split_part(split_part(regexp_replace(regexp_replace(lower(trim(url)),'^https?://',''),'^(www[.]|m[.])',''),'?',1),'#',1),'/') AS bare,
 regexp_replace(rtrim(trim(url),'/'),'^(?i)http://','https://') AS https,
 regexp_extract(rtrim(url,'/'),'([^/]+)$',1) AS segment, regexp_replace(url,'[^A-Za-z0-9]+','_','g') AS stem,
 regexp_replace(url||'/index.html','(^|/)index[.]html$',chr(92)||'1') AS page FROM pages""")
def normalize_urls(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", t.url_plain(u).alias("plain"), t.url_bare(u).alias("bare"), t.url_https(u).alias("https"), t.last_segment(u).alias("segment"), t.file_stem(u).alias("stem"), t.page_url(F.concat(u, L("/index.html"))).alias("page")
    )


@register("soft_truncate_texts", "J16 H8", r"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text,'\s+',' ','g')) AS v FROM documents), c AS (SELECT *, left(v,160) AS cut FROM s)
SELECT doc_id, CASE WHEN length(v)>170 THEN regexp_replace(CASE WHEN contains(cut,' ') THEN regexp_replace(cut,' [^ ]*$','') ELSE cut END,'[ ,.;—-]+$','') ELSE v END AS summary FROM c""")
def soft_truncate_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.soft_truncate(F.col("text")).alias("summary"))


@register("round_half_even", "J25", "SELECT l_returnflag, round_even(sum(l_discount)/count(*), 3) AS mean FROM lineitem GROUP BY 1")
def round_half_even(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.bround(F.sum("l_discount") / F.count("*"), 3).alias("mean"))


@register("caps_ratios", "D6 D5 J25", r"""
WITH s AS (SELECT doc_id, text, length(regexp_replace(text,'\PL','','g')) AS l, length(regexp_replace(text,'\P{Lu}','','g')) AS u FROM documents)
SELECT doc_id, CASE WHEN l=0 THEN 0.0 ELSE round(u/l,2) END AS ratio FROM s""")
def caps_ratios(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.caps_ratio(F.col("text")).alias("ratio"))


@register("heading_slugs", "C9 J15", """
WITH s AS (SELECT page_id, regexp_extract(html,'<h1>(.*?)</h1>',1) AS h FROM pages), w AS (SELECT page_id, list_filter(string_split_regex(regexp_replace(h,'[^А-Яа-яA-Za-z0-9 -]','','g'),' +'), lambda x: x<>'')[1:3] AS w FROM s)
SELECT page_id, CASE WHEN len(w)=0 THEN 'section' ELSE array_to_string(list_transform(w, lambda x: lower(x)),'-') END AS slug FROM w""")
def heading_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.slug(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("slug"))


@register("identifier_checks", "D10 D16", """
SELECT p_partkey, regexp_matches('P'||p_partkey, '^[A-Za-z0-9_-]{1,40}$') AS id_ok, regexp_matches(p_name,'^[a-z]{3,6}$') AS nick_ok,
 regexp_matches('docs/art/'||p_partkey||'.doc','^(docs/|manifest[.]json$)') AND NOT contains('docs/art/'||p_partkey,'..') AS path_ok FROM part""")
def identifier_checks(spark, sf_dir):
    path = F.concat(L("docs/art/"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(L("P"), F.col("p_partkey").cast("string")).rlike("^[A-Za-z0-9_-]{1,40}$").alias("id_ok"),
        F.col("p_name").rlike("^[a-z]{3,6}$").alias("nick_ok"),
        (F.concat(path, L(".doc")).rlike(r"^(docs/|manifest[.]json$)") & ~F.contains(path, L(".."))).alias("path_ok"),
    )


@register("verse_shapes", "D7 C27", r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text,chr(10)), lambda x: trim(x)<>'') AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_lines, len(l)>=2 AND list_sum(list_transform(l, lambda x: length(trim(x))))/len(l) < 50 AS verse FROM l""")
def verse_shapes(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    size = F.aggregate(lines, L(0), lambda a, x: a + F.length(F.trim(x)))
    return table(spark, sf_dir, "documents").select("doc_id", big(F.size(lines)).alias("n_lines"), ((F.size(lines) >= 2) & (size / F.greatest(F.size(lines), L(1)) < 50)).alias("verse"))


_OURL = "'/'||strftime(o_orderdate,'%Y/%m/%d')||'/'||o_orderkey"


@register("url_dates", "K2 K3", f"""
SELECT o_orderkey, o_orderdate::DATE AS url_day, o_orderkey::BIGINT AS number,
 CASE WHEN abs(date_diff('day', o_orderdate::DATE, DATE '1995-01-01')) < 2190 THEN DATE '1995-01-01' ELSE o_orderdate::DATE END AS chosen,
 CASE WHEN abs(date_diff('day', o_orderdate::DATE, DATE '1995-01-01')) < 2190 THEN 'text' ELSE 'url' END AS source FROM orders""")
def url_dates(spark, sf_dir):
    url = F.concat(L("https://x/"), F.date_format("o_orderdate", "yyyy/MM/dd"), L("/"), F.col("o_orderkey").cast("string"))
    day, other = d.url_date(url), L("1995-01-01").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("url_day"), big(d.url_number(url)).alias("number"), d.chosen_date(other, day).alias("chosen"), d.date_source(other, day).alias("source"))


@register("authorship_dates", "K4", """
SELECT l_orderkey, coalesce(min(l_shipdate) FILTER (l_shipdate <= o_orderdate AND l_returnflag <> 'A'), any_value(o_orderdate))::DATE AS day,
 count(*) FILTER (l_shipdate > o_orderdate)::BIGINT AS later FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def authorship_dates(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    fits = (F.col("l_shipdate") <= F.col("o_orderdate")) & (F.col("l_returnflag") != "A")
    return both.groupBy("l_orderkey").agg(F.coalesce(F.min(F.when(fits, F.col("l_shipdate"))), F.first("o_orderdate")).cast("date").alias("day"), F.count_if(F.col("l_shipdate") > F.col("o_orderdate")).alias("later"))


@register("expired_tokens", "K9", "SELECT event_id, floor(epoch(ts)) < 1705000000 AS expired, floor(epoch(ts)) < 1705000300 AS soon FROM events")
def expired_tokens(spark, sf_dir):
    s = F.timestamp_diff("SECOND", L("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts")  # as written, whatever the session's zone
    return table(spark, sf_dir, "events").select("event_id", d.expired(s, L(1705000000)).alias("expired"), d.expired(s, L(1705000000), 300).alias("soon"))


