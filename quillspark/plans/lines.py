"""Text, date and verse forms over lines that are made of the tables' rows, so that every row has a line of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import dates as d, markup as m, text as t
from quillspark.operators import edits as e, joins, sequence as seq, similarity as sim, verse
from quillspark.plans.registry import register
from quillspark.sources import files
from quillspark.sources.tables import literal, table
from quillspark.streaming import machine

L = F.lit
#: A year of Russian month names in the genitive, as dates have them (fixed values).
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def cat(*parts):
    return F.concat(*(L(p) if isinstance(p, str) else p for p in parts))


def s(column):
    return F.col(column).cast("string")


def pick(key, *values):
    """One of the values by the key modulo their number; what the oracle writes as a list index."""
    return F.element_at(F.array(*(L(v) if isinstance(v, str) else v for v in values)), (key % len(values) + 1).cast("int"))


# -- similarity and folding ---------------------------------------------------------------------


@register("similarity_ratios", "J12 J13", """
SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 2.0*length(p_name)/(2*length(p_name)+2) ELSE 2.0*length(split_part(p_name,' ',1))/(length(p_name)+length(split_part(p_name,' ',1))) END AS score FROM part""")
def similarity_ratios(spark, sf_dir):
    """Case, marks, brackets and punctuation don't count; two letters more; the first word alone; nothing at all."""
    name = F.col("p_name")
    other = pick(F.col("p_partkey"), cat("«", F.upper(name), "» (live)!"), "", cat("ъь", name), F.split_part(name, L(" "), L(1)))
    return table(spark, sf_dir, "part").select("p_partkey", sim.ratio_of(name, other).alias("score"))


@register("strip_combining_marks", "J13", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def strip_combining_marks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sim.folded("text")).alias("folded"))


@register("base64_round_trip", "J22 A17", """
SELECT doc_id, rtrim(replace(replace(base64(encode(text)),'+','-'),'/','_'),'=') AS code, text AS back FROM documents""")
def base64_round_trip(spark, sf_dir):
    code = t.base64_url(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), t.from_base64_url(code).alias("back"))


@register("outside_regions", "J27 J17", "SELECT doc_id, md5('<i>keep  it</i>' || regexp_replace(text,' +','_','g')) AS changed FROM documents")
def outside_regions(spark, sf_dir):
    """Runs of spaces change outside the region; regions come out as they were."""
    text = cat("<i>keep  it</i>", F.col("text"))
    pieces = F.split(text, r"(?<=</i>)|(?=<i>[^<]*</i>)")
    changed = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"(?s)\A<i>.*</i>\z"), x).otherwise(F.regexp_replace(x, " +", "_"))), "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(changed).alias("changed"))


@register("bare_link_warnings", "D12", r"""
WITH s AS (SELECT doc_id, text||CASE WHEN doc_id%3=0 THEN ' https://a.b' WHEN doc_id%3=1 THEN ' [https://a.b|x]' ELSE '' END AS x FROM documents) SELECT doc_id, regexp_matches(x,'(^|[^\[|])https?://') AS warn FROM s""")
def bare_link_warnings(spark, sf_dir):
    body = cat("---\nurl: https://q\n---\n[mus]\nhttps://y\n[/mus]\n", F.col("text"), F.when(F.col("doc_id") % 3 == 0, " https://a.b").when(F.col("doc_id") % 3 == 1, " [https://a.b|x]").otherwise(""))
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n", ""), r"(?s)\[mus[^\]]*\].*?\[/mus\]", "")
    return table(spark, sf_dir, "documents").select("doc_id", bare.rlike(r"(?<![\[|])https?://").alias("warn"))


# -- words and titles --------------------------------------------------------------------------------


@register("stem_nouns", "J3 D8", """
WITH w AS (SELECT s_suppkey, ['творец','орёл','Царь','роза','Ёж','край','ЛЕС'][s_suppkey%7+1] AS w, replace(upper(s_name),'#','') AS n FROM supplier), f AS (SELECT s_suppkey, w, replace(upper(w),'Ё','Е') AS folded, n FROM w)
SELECT s_suppkey, folded, CASE folded WHEN 'ТВОРЕЦ' THEN 'ТВОРЦ' WHEN 'ОРЕЛ' THEN 'ОРЛ' ELSE CASE WHEN folded[-1] IN ('Ь','Й','А','Я') THEN folded[:-2] ELSE folded END END AS stem, n AS name FROM f""")
def stem_nouns(spark, sf_dir):
    folded = t.fold_upper(pick(F.col("s_suppkey"), "творец", "орёл", "Царь", "роза", "Ёж", "край", "ЛЕС"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", folded.alias("folded"), t.oblique_stem(folded).alias("stem"), t.fold_upper(F.replace("s_name", L("#"), L(""))).alias("name"))


@register("match_proper_nouns", "D8", """
WITH b AS (SELECT DISTINCT upper(n_name) AS base, CASE WHEN upper(n_name)[-1]='A' THEN upper(n_name) ELSE upper(n_name) END AS stem FROM nation),
e(ending) AS (VALUES (''),('А'),('Я'),('У'),('Ю'),('Е'),('Ы'),('И'),('О'),('ОМ'),('ЕМ'),('ОВ'),('ЕВ'),('АМ'),('ЯМ'),('АМИ'),('ЯМИ'),('АХ'),('ЯХ'),('ОЙ'),('ЕЙ'),('ОЮ'),('ЕЮ'),('Ь'),('Й')),
w AS (SELECT s_suppkey, upper(n_name)||['','ОМ','АМИ','QQ'][s_suppkey%4+1] AS word FROM supplier JOIN nation ON n_nationkey=s_nationkey)
SELECT s_suppkey, min(base) AS base FROM w LEFT JOIN (SELECT base, stem||ending AS form FROM b, e) f ON form=word GROUP BY 1""")
def match_proper_nouns(spark, sf_dir):
    """Names with the endings of cases meet their nouns; each noun's forms are a bounded list, so the join is by equality."""
    nations = table(spark, sf_dir, "nation")
    base = nations.select(F.upper("n_name").alias("base")).distinct().withColumn("stem", t.oblique_stem(F.col("base")))
    endings = sorted({x.replace("Ё", "Е") for x in t.CASE_ENDINGS})
    forms = base.select("base", F.explode(F.array_union(F.array("base"), F.transform(F.array(*map(L, endings)), lambda x: F.concat("stem", x)))).alias("form"))
    names = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.upper("n_name").alias("n"))
    asked = table(spark, sf_dir, "supplier").join(names, "s_nationkey").select("s_suppkey", t.fold_upper(F.concat("n", pick(F.col("s_suppkey"), "", "ом", "ами", "qq"))).alias("form"))
    return asked.join(forms, "form", "left").groupBy("s_suppkey").agg(F.min("base").alias("base"))


@register("video_ids", "J9 A18", """
SELECT p_partkey, CASE WHEN p_partkey%6<3 THEN lpad(p_partkey::VARCHAR,11,'-') END AS vid, CASE WHEN p_partkey%6<4 THEN lpad(p_partkey::VARCHAR,11,'-') END AS wide FROM part""")
def video_ids(spark, sf_dir):
    v = F.lpad(s("p_partkey"), 11, "-")
    url = pick(F.col("p_partkey"), cat("https://www.youtube.com/watch?v=", v, "&t=3"), cat("https://youtu.be/", v, "?x"), cat("https://youtube.com/embed/", v), cat("https://img.example/vi/", v, "/0.jpg"), F.col("p_name"), cat("https://youtu.be/", F.left(v, L(9))))
    return table(spark, sf_dir, "part").select("p_partkey", t.video_id(url).alias("vid"), t.video_id(url, wide=True).alias("wide"))


@register("normalize_titles", "J11 J27 E27", """
SELECT p_partkey, CASE WHEN p_partkey%5=4 THEN '' ELSE 'елка '||p_name||' d' END AS words, CASE WHEN p_partkey%5=4 THEN '' ELSE 'елкаlive'||replace(p_name,' ','')||p_size||'d' END AS key,
 CASE WHEN p_partkey%5=4 THEN '' ELSE 'елка live '||p_name||' '||p_size||' d' END AS spaced, CASE WHEN p_partkey%5=4 THEN '' ELSE 'Ёлка (live) — «'||p_name||'» -d' END AS bare, CASE WHEN p_partkey%5=4 THEN 0 ELSE 1 END::BIGINT AS n_marks FROM part""")
def normalize_titles(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 5 != 4, cat("Ёлка (live) — «", F.col("p_name"), "»[^", s("p_size"), "] -d"))
    v = F.coalesce(title, L(""))
    return table(spark, sf_dir, "part").select("p_partkey", t.title_words(v).alias("words"), t.title_key(v).alias("key"), t.title_spaced(v).alias("spaced"), t.strip_marks(title).alias("bare"), F.size(t.marks(title)).cast("long").alias("n_marks"))


@register("quoted_words", "J11 E13", "SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN p_name||' слово да' ELSE p_name||' '||lower(p_type) END AS quote FROM part")
def quoted_words(spark, sf_dir):
    """A quotation without its number, the lemma it opens with, quote marks and punctuation."""
    line = F.when(F.col("p_partkey") % 2 == 0, cat(s("p_size"), ") Начало и т. д.: «", F.col("p_name"), "», Слово, да!")).otherwise(cat("  “", F.col("p_name"), "”;   ", F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", t.quote_words(line).alias("quote"))


@register("restore_colons", "J17", """
SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN 'Музыка: '||p_name WHEN 1 THEN 'см. также: '||p_name WHEN 2 THEN p_name||' — '||p_brand ELSE 'Глава: '||p_name||' — '||p_brand END AS line FROM part""")
def restore_colons(spark, sf_dir):
    name, brand = F.col("p_name"), F.col("p_brand")
    line = pick(F.col("p_partkey"), cat("Музыка:: ", name), cat("см. также  :: ", name), cat(name, " :: ", brand), cat("Глава::", name, "::", brand))
    return table(spark, sf_dir, "part").select("p_partkey", t.double_colon(line).alias("line"))


@register("star_marks", "J35", "SELECT s_suppkey, s_name||['*','**','x'][s_suppkey%3+1] AS mark FROM supplier")
def star_marks(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", t.star(cat(F.col("s_name"), pick(F.col("s_suppkey"), "★", "✱＊", "x"))).alias("mark"))


@register("fnv_hashes", "J21", """
SELECT p_partkey, printf('%08x', list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name,''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT)) AS hash FROM part""")
def fnv_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.fnv1a(F.col("p_name")).alias("hash"))


@register("caps_lines", "D5 C19", """
SELECT s_suppkey, [true, length('ДА БУДЕТ')-1 >= 0.7*(length('ДА БУДЕТ')-1+s_suppkey%9), false, true][s_suppkey%4+1] AS caps FROM supplier""")
def caps_lines(spark, sf_dir):
    """Letters of other scripts and tags don't count; lower-case letters do."""
    k = F.col("s_suppkey")
    line = pick(k, cat("<b>СВЕТ</b> И ТЬМА ", F.col("s_name")), cat("ДА БУДЕТ", F.repeat(L("ы"), (k % 9).cast("int"))), cat("ДА ", F.col("s_name")), "ЁЛКИ-палки И МНОГОЕ ИНОЕ")
    return table(spark, sf_dir, "supplier").select("s_suppkey", t.caps_line(line).alias("caps"))


@register("split_escaped_fields", "C10 C13", """
SELECT p_partkey, ([3,4,2,1][p_partkey%4+1])::BIGINT AS n, CASE p_partkey%4 WHEN 0 THEN p_name||'|'||p_brand WHEN 2 THEN '' ELSE p_name END AS first FROM part""")
def split_escaped_fields(spark, sf_dir):
    name = F.col("p_name")
    parts = t.split_escaped(pick(F.col("p_partkey"), cat(name, "\\|", F.col("p_brand"), "|b|c"), cat(name, "|y||z"), "|", name))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(parts).cast("long").alias("n"), parts[0].alias("first"))


@register("truthy_words", "D18 DM2", """
SELECT o_orderkey, o_orderkey%6 IN (0,1) OR o_orderstatus='1' AS yes, o_orderkey%6 IN (2,3) AS no FROM orders""")
def truthy_words(spark, sf_dir):
    flag = pick(F.col("o_orderkey"), "On", " да ", "0", "нет", F.col("o_orderstatus"), L(None).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.truthy(flag).alias("yes"), t.falsy(flag).alias("no"))


#: Captions that stand in for a title (fixed pattern).
_PLACE = "(трек под настроени[ея]|музыка( в тему| под настроени[ея]| в теме)?|видео([- ]?пандан| к части| в тему)?|под настроение|слушать(\\s+(на|онлайн))?|смотреть(\\s+(на|онлайн))?|в тему)(\\s*[(][^)]*[)])?"


def is_junk(slot):
    """Whether a slot holds no title: a play mark, a link or a bare video id, or a caption that stands in for one."""
    v = F.trim(slot)
    w = F.btrim(F.regexp_replace(F.trim(F.regexp_replace(v, r"(?i)(?:https?://|www\.youtube|youtu\.be/|youtube\.com/)\S*", "")), r"(?i)\byoutube\b", ""), L(" :|–—-"))
    return v.isin("", "▶ YouTube", "^", "—", "-", "|") | (w == "") | w.rlike("^[A-Za-z0-9_-]{11}$") | w.rlike(r"^(?iu)(музыка|трек)?\s*под настроени[ея]") | w.rlike(f"^(?iu){_PLACE}$")


@register("junk_slots", "D4", "SELECT p_partkey, p_partkey%8 NOT IN (3,5) AS junk FROM part")
def junk_slots(spark, sf_dir):
    v, name = F.lpad(s("p_partkey"), 11, "x"), F.col("p_name")
    slot = pick(F.col("p_partkey"), "▶ YouTube", cat("https://youtu.be/", v), v, cat(name, " — Artist"), "трек под настроение", cat("слушать ", name), cat("Музыка в тему (", name, ")"), " — ")
    return table(spark, sf_dir, "part").select("p_partkey", is_junk(slot).alias("junk"))


@register("italic_candidates", "D9 J28", """
SELECT p_partkey, p_partkey%4 IN (0,2) AS italic, CASE p_partkey%4 WHEN 0 THEN 'a _'||p_name||'_, b' WHEN 1 THEN 'snake_'||p_type||'_name' WHEN 2 THEN '[[A1]] _'||p_name||'_ [u|v]' ELSE p_name||' [x](y)' END AS line FROM part""")
def italic_candidates(spark, sf_dir):
    """Bracketed words become italic but for links and references; then what stands between underscores as a word is italic."""
    name = F.col("p_name")
    line = pick(F.col("p_partkey"), cat("a _", name, "_, b"), cat("snake_", F.col("p_type"), "_name"), cat("[[A1]] [", name, "] [u|v]"), cat(name, " [x](y)"))
    made = F.regexp_replace(line, r"(?<!\[)\[([^\[\]|^]{1,60})\](?![\](])", "_$1_")
    return table(spark, sf_dir, "part").select("p_partkey", made.rlike(r"(?U)(?<![\w/])_[^_\n]{1,60}_(?!\w)").alias("italic"), made.alias("line"))


def title_pattern(title):
    """A pattern for a title in running text: long words by stem and any ending, anything but letters between."""
    words = F.filter(F.split(title, r"[\s\p{Punct}]+"), lambda w: w != "")
    one = lambda w: F.when(F.length(w) >= 5, F.concat(F.left(w, F.length(w) - 2), L("[a-zа-яё]*"))).otherwise(w)
    return F.concat(L("(?i)"), F.array_join(F.transform(words, one), r"[^0-9A-Za-zА-Яа-яЁё]*"))


_PATTERN_SQL = "'(?i)'||array_to_string(list_transform(string_split({0},' '), lambda w: CASE WHEN length(w)>=5 THEN left(w,length(w)-2)||'[a-zа-яё]*' ELSE w END), '[^0-9A-Za-zА-Яа-яЁё]*')"


@register("title_patterns", "J29 E6", f"""
WITH n AS (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other FROM part)
SELECT p_partkey, regexp_matches(upper(p_name), {_PATTERN_SQL.format('p_name')}) AS same, regexp_matches(array_to_string(list_transform(string_split(p_name,' '), lambda w: CASE WHEN length(w)>=5 THEN left(w,length(w)-1)||'ing' ELSE w END),'», '), {_PATTERN_SQL.format('p_name')}) AS bent,
 regexp_matches(other, {_PATTERN_SQL.format('p_name')}) AS other FROM n""")
def title_patterns(spark, sf_dir):
    """A title's pattern on the title in capitals, on it with other endings and marks, and on the next title of the brand."""
    rows = seq.neighbours(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "p_name")
    pattern = title_pattern(F.col("p_name"))
    bent = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.when(F.length(w) >= 5, F.concat(F.left(w, F.length(w) - 1), L("ing"))).otherwise(w)), "», ")
    return rows.select("p_partkey", F.regexp_like(F.upper("p_name"), pattern).alias("same"), F.regexp_like(bent, pattern).alias("bent"), F.regexp_like("next", pattern).alias("other"))


@register("relink_choices", "E6 J18 J29 B9", """
SELECT p_partkey, ['HREF-ONLY','WRAP','WRAP-OVR','REVIEW','ANCHOR'][p_partkey%5+1] AS action FROM part""")
def relink_choices(spark, sf_dir):
    """What a link to a known page becomes: only its target where its own words are the title; the title just before it
    wrapped (overlap of 0.55 in 160 characters), or the words that override it (0.45 in 95); an anchor inside the page; else a review."""
    key, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    link = cat("https://x.y/", s("p_partkey"))
    line = pick(key, cat("[", link, "|", name, "]"), cat("read ", name, " ", link), cat("read «", kind, " other words» ", link), cat("nothing like it ", link), cat("[#p", s("p_partkey"), "|", name, "]"))
    title = F.when(key % 5 == 2, cat(kind, " other more")).otherwise(name)
    shown = F.regexp_extract(line, r"\[https?://[^|\]]+\|([^\]]+)\]", 1)
    before = F.substring_index(line, "https://", 1)
    quoted = F.regexp_extract(before, r"«([^»]+)»\s*$", 1)
    action = (
        F.when(line.rlike(r"\[#[^|\]]+\|"), "ANCHOR")
        .when((shown != "") & (t.stem_overlap(title, shown) >= 0.55), "HREF-ONLY")
        .when((quoted == "") & (t.stem_overlap(title, F.right(before, L(160))) >= 0.55), "WRAP")
        .when((quoted != "") & (t.stem_overlap(title, F.right(before, L(95))) >= 0.45), "WRAP-OVR")
        .otherwise("REVIEW")
    )
    return table(spark, sf_dir, "part").select("p_partkey", action.alias("action"))


@register("token_subsequences", "E23", """
WITH p AS (SELECT p_partkey, p_name, p_brand, p_partkey%3 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN len(string_split(p_name,' '))+2 ELSE 0 END::INT AS at_token FROM p""")
def token_subsequences(spark, sf_dir):
    """The place of a run of tokens that stands once; 0 where it stands never or again."""
    part = table(spark, sf_dir, "part")
    wanted = F.array(F.col("p_brand"), L("#"), F.col("p_brand"))
    line = pick(F.col("p_partkey"), cat(F.col("p_name"), " @ ", F.array_join(wanted, " "), " end"), cat(F.array_join(wanted, " "), " x ", F.array_join(wanted, " ")), cat(F.col("p_brand"), " # ", F.col("p_name")))
    tokens = F.split(line, " ")
    places = F.filter(F.sequence(L(1), F.greatest(F.size(tokens) - F.size(wanted) + 1, L(1))), lambda i: F.slice(tokens, i, F.size(wanted)) == wanted)
    return part.select("p_partkey", F.when(F.size(places) == 1, places[0]).otherwise(0).alias("at_token"))


# -- dates and times ------------------------------------------------------------------------------------


@register("first_dates", "K1", """
SELECT o_orderkey, CASE WHEN o_orderkey%5=4 THEN NULL WHEN o_orderkey%5=2 THEN date_trunc('month',o_orderdate)::DATE ELSE o_orderdate::DATE END AS day FROM orders""")
def first_dates(spark, sf_dir):
    """A numeric date, day and month's word, a month's word alone (its first day), a date that isn't in the calendar before one that is, a date glued to letters."""
    day = F.to_date("o_orderdate")
    word = F.element_at(F.array(*map(L, MONTHS)), F.month(day))
    nominative = F.initcap(F.regexp_replace(F.regexp_replace(word, "та$|та$", "т"), "я$", "ь"))
    line = pick(F.col("o_orderkey"), cat("on ", F.date_format(day, "d.M.yyyy"), " г."), cat("31.02.2021 and ", F.dayofmonth(day).cast("string"), " ", word, " ", F.year(day).cast("string")), cat("as of ", F.when(F.month(day) == 5, "Май").otherwise(nominative), " ", F.year(day).cast("string")), cat(F.date_format(day, "dd/MM/yyyy"), " then 1.1.2001"), cat("ж", F.date_format(day, "dd.MM.yyyy"), "ж"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.first_date(line).alias("day"))


@register("date_id_codes", "K5", """
WITH o AS (SELECT o_orderkey, (o_orderdate + INTERVAL (o_orderkey%50) YEAR)::DATE AS day, o_orderkey%2800 AS n FROM orders), p AS (SELECT *, year(day) AS y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz' AS a FROM o)
SELECT o_orderkey, CASE WHEN y BETWEEN 2020 AND 2029 THEN (y-2020)::VARCHAR WHEN y BETWEEN 1994 AND 2019 THEN chr((y-2019+90)::INT) WHEN y BETWEEN 2030 AND 2055 THEN chr((y-2030+97)::INT) ELSE 'Y'||y END
 || CASE WHEN month(day)<=9 THEN month(day)::VARCHAR ELSE chr((month(day)+55)::INT) END || CASE WHEN day(day)<=9 THEN day(day)::VARCHAR ELSE chr((day(day)+55)::INT) END
 || CASE WHEN n=0 THEN '' WHEN n<=52 THEN a[n] WHEN n<=2756 THEN a[(n-1)//52]||a[(n-1)%52+1] ELSE a[((n-1)//52-1)//52]||a[((n-1)//52-1)%52+1]||a[(n-1)%52+1] END AS id FROM p""")
def date_id_codes(spark, sf_dir):
    key = F.col("o_orderkey")
    day = F.add_months(F.to_date("o_orderdate"), ((key % 50) * 12).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.date_id(day, key % 2800).alias("id"))


@register("durations", "K7", """
WITH v AS (SELECT o_orderkey, (o_orderkey*37)%20000 AS v FROM orders), s AS (SELECT o_orderkey, CASE WHEN o_orderkey%7<>6 THEN v END AS v FROM v)
SELECT o_orderkey, v AS seconds, CASE WHEN v>=3600 THEN (v//3600)||':'||lpad(((v%3600)//60)::VARCHAR,2,'0')||':'||lpad((v%60)::VARCHAR,2,'0') WHEN v IS NOT NULL THEN (v//60)||':'||lpad((v%60)::VARCHAR,2,'0') END AS text FROM s""")
def durations(spark, sf_dir):
    v = (F.col("o_orderkey") * 37) % 20000
    h, minutes, rest = F.floor(v / 3600), F.floor(v % 3600 / 60), v % 60
    text = F.when(F.col("o_orderkey") % 7 == 6, cat(s("o_orderkey"), " min")).when(h > 0, F.format_string("%d:%d:%02d", h, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))
    seconds = F.transform(F.array(text), d.seconds)[0]  # a lambda's value is made once
    back = F.transform(F.array(seconds), lambda x: F.when(x.isNotNull(), d.duration(x)))[0]
    return table(spark, sf_dir, "orders").select("o_orderkey", seconds.alias("seconds"), back.alias("text"))


@register("date_lines", "K8 C31", "SELECT o_orderkey, o_orderkey%4 IN (0,3) AS date_line FROM orders")
def date_lines(spark, sf_dir):
    day = F.to_date("o_orderdate")
    line = pick(F.col("o_orderkey"), cat(F.date_format(day, "dd.MM.yyyy"), " г."), cat("Moscow, ", F.date_format(day, "d/M/yy")), F.col("o_orderpriority"), F.date_format(day, "d-M-yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.is_date_line(line).alias("date_line"))


@register("reset_times", "K6", """
WITH e AS (SELECT event_id, date_trunc('second',ts) AS now, event_id%4 AS k, (event_id%12+1)::INT AS h, (event_id%60)::INT AS m FROM events),
c AS (SELECT *, date_trunc('day',now) + INTERVAL (CASE WHEN k=1 THEN h%12+12 ELSE h%12 END) HOUR + INTERVAL (CASE WHEN k=2 THEN m ELSE 0 END) MINUTE AS clock FROM e)
SELECT event_id, CASE k WHEN 0 THEN now + INTERVAL (h) HOUR WHEN 3 THEN NULL ELSE CASE WHEN clock<=now THEN clock + INTERVAL 1 DAY ELSE clock END END AS at_time FROM c""")
def reset_times(spark, sf_dir):
    """Relative hours from an event's time, or a clock time that day or, if past, the next."""
    key = F.col("event_id")
    h = (key % 12 + 1).cast("string")
    line = pick(key, cat("limit: try again in ", h, " hours"), cat("resets ", h, "pm"), cat("Resets at ", h, ":", F.lpad((key % 60).cast("string"), 2, "0"), "am"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", d.reset_time(line, F.date_trunc("second", F.col("ts").cast("timestamp"))).cast("timestamp_ntz").alias("at_time"))


# -- verse ----------------------------------------------------------------------------------------------------

#: Lines of eight and of six syllables, each closed by a mark.
_EIGHT = ("Буря мглою небо кроет,", "Вихри снежные крутила,", "Словно зверь, она завыла,")
_SIX = ("Белеет тут парус,", "Играют все волны,", "И мачта так гнётся,")
_EIGHT_SQL, _SIX_SQL = ("['" + "','".join(x) + "']" for x in (_EIGHT, _SIX))
_POEM_SQL = f"SELECT n_nationkey, CASE WHEN n_nationkey%2=0 THEN 8 ELSE 6 END AS meter, list_transform(range(0, 4+n_nationkey%5), lambda i: CASE WHEN n_nationkey%2=0 THEN {_EIGHT_SQL}[(i+n_nationkey)%3+1] ELSE {_SIX_SQL}[(i+n_nationkey)%3+1] END) AS l FROM nation"


def poems(spark, sf_dir):
    """(n_nationkey, meter, head, poem): lines of one meter in an order of their own, as running text; its first line."""
    key = F.col("n_nationkey")
    line = lambda lines: lambda i: F.element_at(F.array(*map(L, lines)), ((i + key) % 3 + 1).cast("int"))
    at = F.sequence(L(0), (3 + key % 5).cast("int"))
    lines = F.when(key % 2 == 0, F.transform(at, line(_EIGHT))).otherwise(F.transform(at, line(_SIX)))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(key % 2 == 0, 8).otherwise(6).alias("meter"), lines[0].alias("head"), F.array_join(lines, " ").alias("poem"))


@register("verse_split", "G19 G20 G22 DM18 J24", f"WITH p AS ({_POEM_SQL}) SELECT n_nationkey, unnest(range(0,len(l)))::INT AS pos, unnest(l) AS line, meter::BIGINT AS syllables FROM p")
def verse_split(spark, sf_dir):
    lines = poems(spark, sf_dir).select("n_nationkey", F.posexplode(verse.split_verse("poem", "meter")["lines"]).alias("pos", "l"))
    return lines.select("n_nationkey", "pos", F.col("l.text").alias("line"), F.col("l.syllables").alias("syllables"))


@register("verse_meter", "G21 G22 M5", f"""
WITH p AS ({_POEM_SQL}), d AS (SELECT *, meter=6 AND len(l)%2=0 AS pairs FROM p)
SELECT n_nationkey, CASE WHEN pairs THEN 12 ELSE meter END::BIGINT AS meter, CASE WHEN pairs THEN array_to_string(list_transform(range(0,len(l)//2), lambda i: l[2*i+1]||' '||l[2*i+2]),' | ') ELSE array_to_string(l,' | ') END AS marked, true AS stable FROM d""")
def verse_meter(spark, sf_dir):
    """The meter found in running text, the text marked by it, and marked again.  Of equally good meters the largest counts, so an
    even number of six-syllable lines are lines of twelve."""
    found = poems(spark, sf_dir).withColumn("v", verse.split_verse("poem", L(None).cast("int")))
    made = found.withColumn("marked", verse.joined(F.col("v"), F.col("poem")))
    return made.select("n_nationkey", "v.meter", "marked", (verse.marked(F.col("marked"), F.col("v.meter").cast("int")) == F.col("marked")).alias("stable"))


@register("verse_overrides", "A10 A11 G19 G22 M5 J23", f"""
WITH p AS ({_POEM_SQL}), f AS (SELECT n_nationkey, meter, l, string_split(l[1],' ') AS w FROM p)
SELECT n_nationkey, CASE WHEN n_nationkey%4=3 THEN array_to_string(l,' ') ELSE array_to_string(list_concat(CASE WHEN n_nationkey%4=2 THEN [l[1]] ELSE [w[1], array_to_string(w[2:],' ')] END, l[2:]),' | ') END AS marked, n_nationkey%4=3 AS failed FROM f""")
def verse_overrides(spark, sf_dir):
    """A block that stands once cuts the first line after its first word; one from another text changes nothing; one that
    stands more than once is an error, and the text stays as it was.  The dictionary gives a mark between words no syllable."""
    key = F.col("n_nationkey")
    rows = poems(spark, sf_dir).withColumn("poem", F.when(key % 4 == 3, F.col("poem")).otherwise(F.concat(L("«"), F.col("poem"))))
    head = F.concat(L("«"), F.regexp_replace("head", r"^(\S+) ", "$1\n"))
    blocks = F.when(key % 4 == 2, "# other\nno such line\n\n").when(key % 4 == 3, cat("# twice\n", F.right(F.regexp_extract("poem", r"(\S+) \S+$", 1), L(99)), "\n")).otherwise(F.concat(L("# one\n"), head, L("\n")))
    found = rows.withColumn("v", verse.splitter(verse.dictionary(["# marks", "« 0"]))("poem", "meter", blocks))
    marked = F.regexp_replace(verse.joined(F.col("v"), F.col("poem")), "^«", "")
    return found.select("n_nationkey", marked.alias("marked"), F.col("v.error").isNotNull().alias("failed"))


@register("verse_sections", "G22 G24 C55 C21", f"""
WITH p AS ({_POEM_SQL}) SELECT n_nationkey, '[fp="Part '||n_nationkey||'"] '||array_to_string(l[1:2],' | ')||' | [fp] '||array_to_string(l[3:],' | ') AS marked FROM p""")
def verse_sections(spark, sf_dir):
    """A named section and a paragraph begin lines of their own and are marked there."""
    lines = verse.split_verse("poem", "meter")["lines"]
    texts = poems(spark, sf_dir).withColumn("l", F.transform(lines, lambda x: x["text"]))
    text = F.concat(L("=== Part "), s("n_nationkey"), L(" ===\n"), F.array_join(F.slice("l", 1, 2), "\n"), L("\n\n"), F.array_join(F.slice("l", 3, 99), "\n"))
    found = texts.withColumn("t", text).withColumn("v", verse.split_verse("t", "meter"))
    return found.select("n_nationkey", verse.joined(F.col("v"), F.col("t")).alias("marked"))


@register("verse_dump", "C55 G24", f"""
WITH p AS ({_POEM_SQL}), l AS (SELECT n_nationkey, meter, unnest(range(0,len(l))) AS i, unnest(l) AS x FROM p) SELECT n_nationkey, lpad((i+1)::VARCHAR,3,'0')||' '||meter||' '||CASE WHEN meter<>8 THEN '!' ELSE ' ' END||' '||x AS line FROM l""")
def verse_dump(spark, sf_dir):
    rows = poems(spark, sf_dir).select("n_nationkey", F.posexplode(verse.split_verse("poem", "meter")["lines"]).alias("pos", "l"))
    return rows.select("n_nationkey", F.format_string("%03d %d %s %s", F.col("pos") + 1, F.col("l.syllables"), F.when(F.col("l.syllables") != 8, "!").otherwise(" "), F.col("l.text")).alias("line"))


@register("count_syllables", "J23 J24 A10", r"""
SELECT s_suppkey, ['молоко','—','ёлка','в','ветер'][s_suppkey%5+1] AS base, ([3,0,2,1,7][s_suppkey%5+1])::BIGINT AS syllables, length(regexp_replace(lower(s_name),'[^аеёиоуыэюя]','','g'))::BIGINT AS named FROM supplier""")
def count_syllables(spark, sf_dir):
    """Vowels, but for what a reading dictionary says of a token, as it is or stripped of marks."""
    lines = literal(spark, "(VALUES ('в 1'),('# note'),('ветер 7')) AS t(line)").filter("line not like '#%'")
    known = lines.select(F.regexp_extract("line", r"^(.*) (-?\d+)$", 1).alias("base"), F.regexp_extract("line", r"^(.*) (-?\d+)$", 2).cast("long").alias("n"))
    words = table(spark, sf_dir, "supplier").withColumn("token", pick(F.col("s_suppkey"), "«Молоко,", "—", "ёлка!", "в", "Ветер…")).withColumn("base", t.strip_set(F.lower("token"), "«»,.!?…"))
    return words.join(F.broadcast(known), "base", "left").select("s_suppkey", "base", F.coalesce("n", t.syllables(F.col("token")).cast("long")).alias("syllables"), t.syllables(F.lower("s_name")).cast("long").alias("named"))


# -- dialogue, mentions, anchors, machines -----------------------------------------------------------------------------


@register("dialog_labels", "C17 C18 C30", """
WITH c AS (SELECT conv_id, turn, role, conv_id%3 AS k FROM conversations), o AS (SELECT *, CASE WHEN k=0 AND role='user' THEN 'User' WHEN k=1 AND role='user' THEN 'User' WHEN k=2 AND role='assistant' THEN 'Ответ' WHEN k=2 AND role='user' THEN 'Иван' END AS own FROM c),
l AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS label FROM o)
SELECT conv_id, turn, label, CASE WHEN own IS NOT NULL THEN 'post' WHEN label IS NULL THEN 'lead' ELSE 'body' END AS part FROM l""")
def dialog_labels(spark, sf_dir):
    """Explicit labels rule a whole talk, so words that look like a label are none there; else the patterns; the rest is body or lead."""
    k, role = F.col("conv_id") % 3, F.col("role")
    said = (
        F.when((k == 0) & (role == "user"), ">> User").when(k == 0, "Bob: looks like a label").when((k == 1) & (role == "user"), "User: hi there").when(k == 1, "plain words follow")
        .when(role == "assistant", "Ответ: да").when(role == "user", "Иван написал(а): да").otherwise("без метки")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("p"), (k == 0).alias("explicit"))
    own = F.when(F.col("explicit"), F.when(F.col("p").rlike(r"^>>\s"), F.trim(F.substring("p", 3, 99)))).otherwise(m.speaker(F.col("p")))
    labelled = seq.carry_forward(rows.withColumn("own", own), ["conv_id"], ["turn"], F.col("own"), "label")
    return labelled.select("conv_id", "turn", "label", F.when(F.col("own").isNotNull(), "post").when(F.col("label").isNull(), "lead").otherwise("body").alias("part"))


@register("mention_scan", "C44 J36 F2", """
SELECT item_id, CASE item_id%4 WHEN 0 THEN 'tag' WHEN 1 THEN 'url' WHEN 2 THEN 'prose' ELSE CASE WHEN regexp_matches(text,'https?://') THEN 'url' WHEN regexp_matches(text,'(?i)source') THEN 'prose' ELSE 'none' END END AS kind, CASE WHEN item_id%4=0 THEN 2 ELSE 0 END AS n_tags FROM benchmark""")
def mention_scan(spark, sf_dir):
    """Tags, else cited addresses, else words that name the source; each line has one kind."""
    line = cat(F.col("text"), pick(F.col("item_id"), " see {alpha|12} https://q and {alpha|12|5}", " https://x.example/Source", " of the Source", ""))
    tags = F.regexp_extract_all(line, L(r"(\{[a-z]+\|\d+(?:\|\d+)?\})"), L(1))
    kind = F.when(F.size(tags) > 0, "tag").when(line.rlike("https?://"), "url").when(line.rlike("(?i)source"), "prose").otherwise("none")
    return table(spark, sf_dir, "benchmark").select("item_id", kind.alias("kind"), F.size(tags).alias("n_tags"))


@register("nested_anchors", "J32 J31", "SELECT page_id, md5(html) AS same, md5(html) AS again FROM pages")
def nested_anchors(spark, sf_dir):
    """Pages without an anchor inside another stay to the byte; so does what is done already."""
    page = e.unnested(F.col("html"))
    deep = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', '<a href="$1">$2</a>')
    return table(spark, sf_dir, "pages").select("page_id", F.md5(page).alias("same"), F.md5(e.unnested(e.unnested(deep))).alias("again"))


@register("nested_anchor_cases", "J32", """
SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN 'a<a href=x>b '||p_name||' d</a>e' WHEN 1 THEN '<script>"<a><a>'||p_name||'</a></a>"</script><a>x</a>' ELSE '<a href=1>'||p_name||'</a><a href=2>y z</a>' END AS html FROM part""")
def nested_anchor_cases(spark, sf_dir):
    name = F.col("p_name")
    html = pick(F.col("p_partkey"), cat("a<a href=x>b <a href=y>", name, "</a> d</a>e"), cat('<script>"<a><a>', name, '</a></a>"</script><a>x</a>'), cat("<a href=1>", name, "</a><a href=2>y <a href=3><a href=4>z</a></a></a>"))
    return table(spark, sf_dir, "part").select("p_partkey", e.unnested(html).alias("html"))


@register("retry_state_machine", "L1 L2 L9 L10", """
WITH c AS (SELECT c_custkey, c_custkey%14 AS fails, c_custkey%3 AS k FROM customer)
SELECT c_custkey, CASE WHEN fails>10 THEN 'failed' WHEN k=0 THEN 'ready' WHEN k=1 THEN 'dismissed' ELSE 'waiting' END AS phase, least(fails,10)::BIGINT AS tries FROM c""")
def retry_state_machine(spark, sf_dir):
    """A customer's deployment: polls, failures a minute apart that each take a try, and at last it is live, dismissed or neither."""
    key = F.col("c_custkey")
    fails = F.transform(F.sequence(L(0), (key % 14).cast("int")), lambda i: F.struct((i * 60).cast("double").alias("at_s"), F.when(i == 0, "poll").otherwise("failed").alias("kind")))
    last = F.struct(((key % 14 + 1) * 60).cast("double").alias("at_s"), pick(key, "live", "dismiss", "poll").alias("kind"))
    events = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.concat(fails, F.array(last))).alias("e")).select("c_custkey", "e.*")
    return machine.replay_all(events, "c_custkey", "at_s", "kind")


@register("batch_runner", "L2 L9 L10 L8", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey%9=0 AS bad, o_orderkey%50=0 AS stop FROM orders),
f AS (SELECT o_custkey, min(n) FILTER (stop) AS fatal FROM r GROUP BY 1)
SELECT o_custkey, count(*) FILTER (NOT bad AND NOT stop AND (fatal IS NULL OR n<fatal)) AS ok, count(*) FILTER (bad AND NOT stop AND (fatal IS NULL OR n<fatal)) AS failed, CASE WHEN any_value(fatal) IS NOT NULL THEN 'stopped' ELSE 'running' END AS phase FROM r JOIN f USING(o_custkey) GROUP BY 1""")
def batch_runner(spark, sf_dir):
    """A customer's orders as a batch: a bad one fails by itself, a fatal one stops the rest; a run of failures this short never stalls."""
    key = F.col("o_orderkey")
    outcome = F.when(key % 50 == 0, "fatal").when(key % 9 == 0, "fail").otherwise("ok")
    return machine.run_batches(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", outcome.alias("outcome")), "o_custkey", "o_orderkey", "outcome")


@register("sql_functions", "M1 M3 M5", """
SELECT p_partkey, '<p>'||p_name||' <em>x</em></p>' AS html, 1.0::DOUBLE AS same, 2::BIGINT AS blocks, p_name AS title FROM part""")
def sql_functions(spark, sf_dir):
    from quillspark.functions.registered import register as names

    names(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("qs_part")
    return spark.sql(
        "SELECT p_partkey, qs_render(concat(p_name, ' _x_')).html AS html, qs_similarity(p_name, upper(p_name)) AS same, CAST(size(qs_parse(concat('## ', p_name, '\\n\\ntext')).blocks) AS BIGINT) AS blocks,"
        " qs_convert(concat('<h1>', p_name, '</h1>')).title AS title FROM qs_part"
    )


# -- tables ------------------------------------------------------------------------------------------------------------


@register("explode_tile_links", "E3 DM8", """
WITH t AS (SELECT p_partkey, unnest(string_split(p_partkey||':own,'||(p_partkey%7)||','||(p_partkey%40),',')) AS x FROM part),
s AS (SELECT p_partkey, split_part(x,':',1)::BIGINT AS id, nullif(split_part(x,':',2),'') AS own FROM t)
SELECT s.p_partkey, id, coalesce(own, n_name, id::VARCHAR) AS label FROM s LEFT JOIN nation ON n_nationkey=id""")
def explode_tile_links(spark, sf_dir):
    key = F.col("p_partkey")
    links = F.concat(s("p_partkey"), L(":own,"), (key % 7).cast("string"), L(","), (key % 40).cast("string"))
    tiles = table(spark, sf_dir, "part").select(key, F.explode(F.split(links, ",")).alias("x"))
    ids = tiles.select("p_partkey", F.split_part("x", L(":"), L(1)).cast("long").alias("id"), F.nullif(F.split_part("x", L(":"), L(2)), L("")).alias("own"))
    titles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    return ids.join(titles, "id", "left").select("p_partkey", "id", F.coalesce("own", "n_name", F.col("id").cast("string")).alias("label"))


@register("nav_global_chain", "G2 G4", """
SELECT o_orderkey, row_number() OVER w AS rank, lpad(row_number() OVER w::VARCHAR,6,'0') AS number, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""")
def nav_global_chain(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("day", F.unix_date(F.to_date("o_orderdate")).cast("long"))
    ranked = seq.chain(orders, "day", ["o_orderkey"], "o_orderkey")
    return ranked.select("o_orderkey", "rank", F.lpad(F.col("rank").cast("string"), 6, "0").alias("number"), "prev", "next")


@register("full_outer_link_audit", "E11 I2 I4 F8", """
SELECT o_orderkey AS key, 'left' AS side FROM orders WHERE o_orderstatus<>'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity>5) UNION ALL
SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_quantity>5 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus<>'P')""")
def full_outer_link_audit(spark, sf_dir):
    left = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    right = table(spark, sf_dir, "lineitem").filter("l_quantity > 5").select(F.col("l_orderkey").alias("key"))
    return joins.two_sided(left, right, "key")


@register("page_anchor_audit", "E30 E11 I2", """
SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN 'lost' ELSE 'ok' END AS state, 's'||(p_partkey%3) AS anchor FROM part""")
def page_anchor_audit(spark, sf_dir):
    """Every entry of a page's contents must lead to an anchor of the page."""
    anchor = cat("s", (F.col("p_partkey") % 3).cast("string"))
    html = cat('<nav class="toc"><a href="#', anchor, '">', F.col("p_name"), '</a></nav><h2 id="s1">x</h2><p><a name="s2"></a>', F.col("p_brand"), "</p>")
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.explode(e.html_nodes(html)).alias("n"))
    asked = nodes.filter("n.tag = 'a' and n.attrs['href'] like '#%'").select("p_partkey", F.substring("n.attrs.href", 2, 99).alias("anchor"))
    known = nodes.select("p_partkey", F.explode(F.array_compact(F.array("n.attrs.id", "n.attrs.name"))).alias("anchor")).distinct().withColumn("state", L("ok"))
    return asked.join(known, ["p_partkey", "anchor"], "left").select("p_partkey", F.coalesce("state", L("lost")).alias("state"), "anchor")


@register("decode_charsets", "A7", """
SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN p_name||'Дя' WHEN p_partkey%3=1 THEN p_name||'a�b' ELSE p_name||'«—»' END AS line FROM part""")
def decode_charsets(spark, sf_dir):
    raw = F.concat(F.encode("p_name", "US-ASCII"), F.unhex(pick(F.col("p_partkey"), "C4FF", "619862", "AB97BB")))
    return table(spark, sf_dir, "part").select("p_partkey", files.decoded(raw).alias("line"))


@register("paged_listing", "A6 I3", """
WITH o AS (SELECT o_custkey, o_orderpriority AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS place FROM orders),
p AS (SELECT *, place//4 AS page, place%4 AS pos FROM o), k AS (SELECT o_custkey, min(page) AS last FROM (SELECT o_custkey, page, count(*) AS n FROM p GROUP BY 1,2) WHERE n<4 GROUP BY 1)
SELECT o_custkey, item, min(page*10+pos)::INT AS first_seen FROM p LEFT JOIN k USING(o_custkey) WHERE last IS NULL OR page<=last GROUP BY 1,2""")
def paged_listing(spark, sf_dir):
    """Pages of four of each customer's priorities, up to and with the first short page; a priority counts where it is first."""
    placed = seq.occurrence(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "k").withColumn("at", F.col("k") - 1)
    rows = placed.select("o_custkey", F.floor(F.col("at") / 4).cast("int").alias("offset"), F.struct("at", F.col("o_orderpriority").alias("item")).alias("x"))
    pages = rows.groupBy("o_custkey", "offset").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))
    return files.pages_of(pages, 4, ["o_custkey"]).select("o_custkey", "item", (F.col("offset") * 10 + F.col("pos")).alias("first_seen"))
