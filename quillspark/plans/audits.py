"""Audits, repairs and run control: matching tiers, repairs that are safe, lists of a run check, whitelists, diffs, templates, modes."""

from __future__ import annotations

import difflib

from pyspark.sql import Window, functions as F, types as T

from quillspark.functions import dates as d
from quillspark.operators import convert, importer, joins, similarity as sim
from quillspark.plans.registry import register
from quillspark.sources.tables import literal, table

L = F.lit


def cat(*parts):
    return F.concat(*(L(p) if isinstance(p, str) else p for p in parts))


def s(column):
    return F.col(column).cast("string")


@register("fuzzy_best_match", "E8 J12", None)
def fuzzy_best_match(spark, sf_dir):
    """Whole texts against all names (brute force in the tests)."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return sim.best_match(asked, "item_id", "text", table(spark, sf_dir, "part").select("p_name"), "p_name")


@register("fuzzy_best_length", "E8 J12 H3", """
WITH n AS (SELECT p_size AS m, min(p_partkey) AS first FROM part GROUP BY 1), a AS (SELECT n_nationkey, n_nationkey*4+1 AS k FROM nation),
s AS (SELECT n_nationkey, m, first, round(2.0*least(k,m)/(k+m),6) AS score, row_number() OVER (PARTITION BY n_nationkey ORDER BY 2.0*least(k,m)/(k+m) DESC, first) AS r FROM a, n)
SELECT n_nationkey, m::BIGINT AS best_length, score, CASE WHEN score>=0.6 THEN 'alternative' ELSE 'new' END AS state FROM s WHERE r=1""")
def fuzzy_best_length(spark, sf_dir):
    """Runs of one letter, whose similarity is that of their lengths; of equal scores the name that comes first in the catalogue."""
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.repeat(L("a"), (F.col("n_nationkey") * 4 + 1).cast("int")).alias("text"))
    names = table(spark, sf_dir, "part").select(F.repeat(L("a"), F.col("p_size").cast("int")).alias("name"), "p_partkey")
    found = sim.best_match(asked, "n_nationkey", "text", names, "name", order="p_partkey")
    return found.select("n_nationkey", F.length("best").cast("long").alias("best_length"), "score", "state")


@register("slot_canonicalisation", "E9 F20 J14", """
SELECT p_partkey, ['KEEP','SWAP','FILL','FILLBOTH','NODB','SPLIT'][p_partkey%6+1] AS action, CASE WHEN p_partkey%2=0 THEN 'keep' ELSE 'swap' END AS split FROM part""")
def slot_canonicalisation(spark, sf_dir):
    k, author = F.col("p_partkey"), cat("qqq zzz ", F.col("p_brand"))
    title = F.when(k % 6 == 1, author).when(k % 6 == 3, "").when(k % 6 == 5, cat(F.col("p_name"), " — ", author)).otherwise(F.col("p_name"))
    by = F.when(k % 6 == 1, F.col("p_name")).when((k % 6).isin(2, 3, 5), "").otherwise(author)
    action = sim.slot_action(title, by, F.when(k % 6 != 4, F.col("p_name")), author)
    both = F.when(k % 2 == 0, cat(F.col("p_name"), " — ", author)).otherwise(cat(author, " — ", F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", action.alias("action"), sim.split_title(both, F.col("p_name"), author).alias("split"))


@register("soft_match", "E12 E10", """
WITH q AS (SELECT s_suppkey, s_suppkey%4 AS k, s_suppkey%(SELECT count(*) FROM part)+1 AS want FROM supplier),
a AS (SELECT q.*, p_name, p_brand FROM q JOIN part ON p_partkey=want), f AS (SELECT p_name, p_brand, min(p_partkey) AS id FROM part GROUP BY 1,2), g AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT s_suppkey, CASE k WHEN 0 THEN want WHEN 1 THEN f.id WHEN 2 THEN g.id END AS found, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS tier FROM a JOIN f ON f.p_name=a.p_name AND f.p_brand=a.p_brand JOIN g ON g.p_name=a.p_name""")
def soft_match(spark, sf_dir):
    """The id if it is known, else the title with the same performer, else the title found inside the text by its words; the
    least id of the best tier."""
    part = table(spark, sf_dir, "part")
    n = part.count()
    k = F.col("s_suppkey") % 4
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", k.alias("k"), (F.col("s_suppkey") % n + 1).alias("p_partkey")).join(part, "p_partkey")
    asked = asked.select("s_suppkey", F.when(F.col("k") == 0, F.col("p_partkey")).alias("id"), F.when(F.col("k").isin(1, 3), F.when(F.col("k") == 3, cat("~", F.col("p_name"))).otherwise(F.col("p_name"))).alias("title"), F.when(F.col("k") == 1, F.col("p_brand")).otherwise("nobody").alias("who"),
                         F.when(F.col("k") == 2, cat("heard of «", F.col("p_name"), "» here")).otherwise("").alias("text"))
    by_id = asked.join(part.select(F.col("p_partkey").alias("id")), "id").select("s_suppkey", F.col("id").alias("found"), L(1).alias("tier"))
    by_title = asked.join(part.select(F.col("p_name").alias("title"), F.col("p_brand").alias("who"), F.col("p_partkey").alias("found")), ["title", "who"]).select("s_suppkey", "found", L(2).alias("tier"))
    # a title inside a text begins at one of the text's words: runs of as many words as titles have meet titles by equality
    words = F.split(F.regexp_replace("text", "[«»]", ""), " ")
    runs = F.flatten(F.transform(F.sequence(L(1), F.size(words)), lambda i: F.transform(F.sequence(L(1), L(3)), lambda m: F.array_join(F.slice(words, i, m), " "))))
    inside = asked.filter("text <> ''").select("s_suppkey", F.explode(F.array_distinct(runs)).alias("p_name"))
    by_words = inside.join(part.select("p_name", F.col("p_partkey").alias("found")), "p_name").select("s_suppkey", F.col("found"), F.length("p_name").alias("size"), L(3).alias("tier"))
    best = by_id.withColumn("size", L(0)).unionByName(by_title.withColumn("size", L(0))).unionByName(by_words)
    top = best.groupBy("s_suppkey").agg(F.min(F.struct("tier", -F.col("size"), "found")).alias("t"))
    return asked.select("s_suppkey").join(top, "s_suppkey", "left").select("s_suppkey", "t.found", "t.tier")


@register("neighbour_repair", "E20 E19 B10", """
WITH o AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target FROM orders)
SELECT o_orderkey, CASE WHEN target IS NULL THEN 'no-target' WHEN o_orderkey%3=0 THEN 'ambiguous' WHEN o_orderkey%3=1 THEN 'repaired' ELSE 'missing' END AS outcome,
 CASE WHEN target IS NOT NULL AND o_orderkey%3=1 THEN '<a href="'||target||'">next</a>' END AS html FROM o""")
def neighbour_repair(spark, sf_dir):
    """A page's link to its next is set right only where the old address stands exactly once and the new target exists."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("target"))
    old = cat('href="old-', s("o_orderkey"), '"')
    html = F.repeat(cat("<a ", old, ">next</a>"), F.when(F.col("o_orderkey") % 3 == 0, 2).when(F.col("o_orderkey") % 3 == 1, 1).otherwise(0))
    times = (F.length(html) - F.length(F.replace(html, old, L("")))) / F.length(old)
    outcome = F.when(F.col("target").isNull(), "no-target").when(times > 1, "ambiguous").when(times == 1, "repaired").otherwise("missing")
    return rows.select("o_orderkey", outcome.alias("outcome"), F.when(outcome == "repaired", F.replace(html, old, cat('href="', s("target"), '"'))).alias("html"))


@register("largest_groups", "F16 H3", """
SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, day LIMIT 10""")
def largest_groups(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(10)


@register("next_orders", "F17", "SELECT c_custkey, coalesce(max(o_orderkey%1000),-1)+1 AS next_order FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def next_orders(spark, sf_dir):
    """One more than the largest place of a section, 0 for a section without rows."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderkey") % 1000).alias("last"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", (F.coalesce("last", L(-1)) + 1).alias("next_order"))


@register("run_check_lists", "F19 H4 F4 H8", """
WITH r AS (SELECT p_partkey, round(((p_partkey*37)%60+70)/100.0,2) AS c, (p_partkey*11)%7=0 AS differs FROM part), b AS (SELECT *, CASE WHEN c<0.97 THEN 'below' WHEN c>1.2 THEN 'above' WHEN differs THEN 'changed' END AS list FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY CASE WHEN list='above' THEN -c ELSE c END, p_partkey) AS place FROM b WHERE list IS NOT NULL)
SELECT list, place, p_partkey, c FROM k WHERE place<=15""")
def run_check_lists(spark, sf_dir):
    """The worst of a run: lowest and highest coverage, and what differs from the golden run, fifteen of each."""
    c = F.round(((F.col("p_partkey") * 37) % 60 + 70) / 100.0, 2)
    rows = table(spark, sf_dir, "part").select("p_partkey", c.alias("c"))
    golden = rows.withColumn("was", F.when((F.col("p_partkey") * 11) % 7 == 0, F.col("c") + 1).otherwise(F.col("c"))).select("p_partkey", "was")
    kind = F.when(F.col("c") < 0.97, "below").when(F.col("c") > 1.2, "above").when(F.col("c") != F.col("was"), "changed")
    listed = rows.join(golden, "p_partkey").withColumn("list", kind).filter("list is not null")
    w = Window.partitionBy("list").orderBy(F.when(F.col("list") == "above", -F.col("c")).otherwise(F.col("c")), "p_partkey")
    return listed.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 15").select("list", "place", "p_partkey", "c")


_ALLOWED = "(VALUES ('V1','split'),('V1','join'),('C2','fold'),('H3','drop')) AS t(code, suggestion)"


@register("findings_whitelist", "D15 B9 I1", f"""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, ['V1','C2','H3','X9'][l_partkey%4+1] AS code, ['split','fold','drop'][l_suppkey%3+1] AS suggestion, l_quantity::INT AS blk FROM lineitem)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, CASE WHEN f.code NOT IN ('V1','C2','H3') THEN 'unknown code' WHEN t.code IS NULL THEN 'not allowed' WHEN blk>40 THEN 'no such block' WHEN blk%10=0 THEN 'heading' ELSE 'ok' END AS verdict
FROM f LEFT JOIN {_ALLOWED} ON t.code=f.code AND t.suggestion=f.suggestion""")
def findings_whitelist(spark, sf_dir):
    """A finding counts if its code allows its suggestion and its block exists and is no heading; else the reason."""
    pick = lambda key, *v: F.element_at(F.array(*map(L, v)), (key % len(v) + 1).cast("int"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pick(F.col("l_partkey"), "V1", "C2", "H3", "X9").alias("code"), pick(F.col("l_suppkey"), "split", "fold", "drop").alias("suggestion"), F.col("l_quantity").cast("int").alias("at"))
    allowed = literal(spark, _ALLOWED).withColumn("allowed", L(True))
    both = found.join(F.broadcast(allowed), ["code", "suggestion"], "left").join(F.broadcast(allowed.select("code").distinct().withColumn("known", L(True))), "code", "left")
    verdict = F.when(F.col("known").isNull(), "unknown code").when(F.col("allowed").isNull(), "not allowed").when(F.col("at") > 40, "no such block").when(F.col("at") % 10 == 0, "heading").otherwise("ok")
    return both.select("l_orderkey", "l_linenumber", "l_partkey", verdict.alias("verdict"))


@register("write_guards", "D16 D10", """
WITH f AS (SELECT o_custkey, CASE o_orderkey%5 WHEN 0 THEN 'manifest.json' WHEN 1 THEN '../x' ELSE 'docs/a'||o_orderkey||CASE WHEN o_orderkey%5=2 THEN '.png' ELSE '.html' END END AS path FROM orders)
SELECT o_custkey, count(*) FILTER (path LIKE 'docs/%' OR path='manifest.json') AS allowed, CASE WHEN count(*) FILTER (path='../x')>0 THEN 'bad path' WHEN count(*)>12 THEN 'too many files' WHEN count(*) FILTER (path LIKE '%.png')>3 THEN 'too many images' ELSE 'ok' END AS verdict FROM f GROUP BY 1""")
def write_guards(spark, sf_dir):
    """A write is refused for a path outside the folder, too many files or too many images."""
    k = F.col("o_orderkey") % 5
    path = F.when(k == 0, "manifest.json").when(k == 1, "../x").otherwise(cat("docs/a", s("o_orderkey"), F.when(k == 2, ".png").otherwise(".html")))
    ok = path.rlike(r"^(docs/|manifest\.json$)") & ~F.contains(path, L(".."))
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(ok).alias("allowed"), F.count("*").alias("n"), F.count_if(F.endswith(path, L(".png"))).alias("images"))
    verdict = F.when(F.col("allowed") < F.col("n"), "bad path").when(F.col("n") > 12, "too many files").when(F.col("images") > 3, "too many images").otherwise("ok")
    return sums.select("o_custkey", "allowed", verdict.alias("verdict"))


@register("uncovered_words", "D19 F3 F11", """
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text),'[a-z]{4,}'))) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY 1 HAVING count(*)>=4),
l AS (SELECT DISTINCT unnest(string_split(p_name,' ')) AS word FROM part)
SELECT w AS word, n FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE length(word)>=4 AND left(word,3)=left(w,3) AND abs(length(word)-length(w))<=3) ORDER BY n DESC, w LIMIT 60""")
def uncovered_words(spark, sf_dir):
    """Words of four documents or more that no word of the lexicon covers: three letters in common at the start and a like length."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), L("[a-z]{4,}"), L(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 4").withColumn("head", F.left("word", L(3)))
    lexicon = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).filter(F.length("w") >= 4)
    forms = lexicon.select(F.left("w", L(3)).alias("head"), F.length("w").alias("size")).distinct()
    covered = counts.join(forms, "head").filter(F.abs(F.length("word") - F.col("size")) <= 3).select("word")
    return counts.join(covered, "word", "left_anti").select("word", "n").orderBy(F.desc("n"), "word").limit(60)


@register("dirty_documents", "D20 L7", "SELECT p_partkey, p_partkey%3=0 OR p_partkey%4=1 OR p_size IS NULL AS dirty FROM part")
def dirty_documents(spark, sf_dir):
    """Changed against the baseline, nulls being values too, or with a picture that waits to be written."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, L(None).cast("string")).otherwise(F.col("p_name")).alias("now"), F.col("p_name").alias("was"))
    waiting = table(spark, sf_dir, "part").filter("p_partkey % 4 = 1").select("p_partkey", L(True).alias("waits"))
    return rows.join(waiting, "p_partkey", "left").select("p_partkey", (joins.changed(F.col("now"), F.col("was")) | F.coalesce("waits", L(False))).alias("dirty"))


def _diff(a: str, b: str, most: int = 300) -> list[str]:
    return list(difflib.unified_diff(a.split("\n"), b.split("\n"), lineterm="", n=0))[2:][:most]


@register("masked_diffs", "J18 J27", """
SELECT p_partkey, p_partkey%3=0 AS same, CASE p_partkey%3 WHEN 0 THEN [] WHEN 1 THEN ['@@ -2 +2 @@','-'||p_brand,'+'||p_type] ELSE ['@@ -2,0 +3 @@','+'||p_type] END AS diff FROM part""")
def masked_diffs(spark, sf_dir):
    """Texts that must agree but for what is masked on both sides (links here, white space too): equal, or the lines that differ."""
    name, brand = F.col("p_name"), F.col("p_brand")
    old = cat(name, "  [http://a|x]\n", brand, "\nend")
    new = F.when(F.col("p_partkey") % 3 == 0, cat(name, " [http://b|x]\n", brand, "\nend")).when(F.col("p_partkey") % 3 == 1, cat(name, " [http://b|x]\n", F.col("p_type"), "\nend")).otherwise(cat(name, " [http://b|x]\n", brand, "\n", F.col("p_type"), "\nend"))
    masked = lambda c: F.regexp_replace(F.regexp_replace(c, r"\[https?://[^|\]]+\|", "[|"), "[ \t]+", " ")
    diff = F.udf(_diff, T.ArrayType(T.StringType()), useArrow=True)
    rows = table(spark, sf_dir, "part").select("p_partkey", masked(old).alias("a"), masked(new).alias("b"))
    return rows.select("p_partkey", (F.col("a") == F.col("b")).alias("same"), F.when(F.col("a") == F.col("b"), F.array().cast("array<string>")).otherwise(diff("a", "b")).alias("diff"))


@register("template_order", "J33 B16 M2", """
SELECT p_partkey, '<title>'||p_name||'</title><nav></nav>{{title}} '||p_brand||' <a class="internal" href="../N1.html">'||(SELECT n_name FROM nation WHERE n_nationkey=1)||'</a>' AS page FROM part""")
def template_order(spark, sf_dir):
    """A page of its own: links with a base before them, no navigation; what the body says like a mark of the template is text, as the body goes in last."""
    name = table(spark, sf_dir, "nation").filter("n_nationkey = 1").first()["n_name"]
    context = convert.Context(titles={"N1": name}, prefix="../")

    def page(title, brand):
        body = convert.Renderer("", context).inline(f"{{{{title}}}} {brand} [[N1]]")
        return convert.filled("<title>{{title}}</title><nav>{{nav}}</nav>{{body}}", {"title": title, "nav": "", "body": body})

    return table(spark, sf_dir, "part").select("p_partkey", F.udf(page, "string", useArrow=True)("p_name", "p_brand").alias("page"))


@register("run_modes", "M6 B13 B14 D2 D3 H8", """
WITH q AS (SELECT o_orderkey, o_orderpriority AS section, o_orderstatus='F' AS done FROM orders),
m(mode) AS (VALUES ('all'),('force'),('section'),('only'),('limit')), s AS (SELECT mode, q.*, row_number() OVER (PARTITION BY mode ORDER BY section, o_orderkey) AS r FROM m, q
 WHERE CASE mode WHEN 'all' THEN NOT done WHEN 'force' THEN true WHEN 'section' THEN NOT done AND section='2-HIGH' WHEN 'only' THEN o_orderkey IN (1,2,3,7) ELSE NOT done END)
SELECT mode, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM s WHERE mode<>'limit' OR r<=50 GROUP BY 1""")
def run_modes(spark, sf_dir):
    """What a run takes: what isn't done, all of it, one section, given ids (done or not), or so many of the queue's first."""
    queue = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("section"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    take = lambda **mode: joins.to_run(queue, done, "o_orderkey", ["section", "o_orderkey"], **mode)
    runs = {"all": take(), "force": take(force=True), "section": take(section=("section", "2-HIGH")), "only": take(only=[1, 2, 3, 7]), "limit": take(limit=50)}
    out = None
    for name, rows in runs.items():
        one = rows.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")).withColumn("mode", L(name))
        out = one if out is None else out.unionByName(one)
    return out


@register("block_scan", "A15 A11 C7", """
SELECT s_suppkey, unnest([s_name, 'in [mus] only']) AS line, unnest([2,5])::INT AS at FROM supplier""")
def block_scan(spark, sf_dir):
    """The lines inside ``[mus]`` blocks, by the running count of marks opened and closed; a mark inside a line is text."""
    text = cat("before\n[mus]\n", F.col("s_name"), "\n[/mus]\n[mus=\"x\"]\nin [mus] only\n[/mus]\nafter")
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.split(text, "\n")).alias("at", "line"))
    opens, closes = F.col("line").rlike(r"^\[mus(=[^\]]*)?\]$").cast("int"), F.col("line").rlike(r"^\[/mus\]$").cast("int")
    w = Window.partitionBy("s_suppkey").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(opens - closes).over(w)
    return lines.withColumn("inside", (depth > 0) & (opens == 0)).filter("inside").select("s_suppkey", "line", "at")


@register("css_remap", "C40 J30", """
SELECT page_id, '.pg'||page_id||' .ttl{color:red}.pg'||page_id||' p,.pg'||page_id||' .ttl b{margin:0}' AS css FROM pages""")
def css_remap(spark, sf_dir):
    """A page's own style under a scope of its own, with a class renamed in selectors only."""
    css = L("h1.title{color:red}p,h1.title b{margin:0}")
    scope = cat(".pg", s("page_id"), " ")
    rules = F.filter(F.split(css, r"\}"), lambda r: r != "")
    selector = lambda x: F.concat(scope, F.regexp_replace(F.trim(x), r"h1\.title", ".ttl"))
    made = F.transform(rules, lambda r: F.concat(F.array_join(F.transform(F.split(F.substring_index(r, "{", 1), ","), selector), ","), L("{"), F.substring_index(r, "{", -1), L("}")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(made, "").alias("css"))


@register("new_documents", "C49 C48 K1", """
SELECT o_orderkey, '---'||chr(10)||'title: Order '||o_orderkey||chr(10)||'id: '||o_orderkey||chr(10)||'date: '||strftime(o_orderdate,'%Y-%m-%d')||chr(10)||'---'||chr(10)||chr(10)||'text' AS src FROM orders""")
def new_documents(spark, sf_dir):
    """A new document from a header line: its title without the date, the date as it is written there."""
    header = cat("Order ", s("o_orderkey"), " (", F.date_format("o_orderdate", "dd.MM.yyyy"), ")")
    day = F.transform(F.array(header), d.first_date)[0]
    title = F.trim(F.regexp_replace(header, r"\s*\(?\d{1,2}\.\d{1,2}\.\d{4}\)?", ""))
    front = cat("---\ntitle: ", title, "\nid: ", s("o_orderkey"), "\ndate: ", F.date_format(day, "yyyy-MM-dd"), "\n---\n\ntext")
    return table(spark, sf_dir, "orders").select("o_orderkey", front.alias("src"))


@register("note_headings", "G25 C51", """
SELECT n_nationkey, CASE WHEN n_nationkey%2=0 THEN 'Links of '||n_name END AS named, CASE WHEN n_nationkey%2=0 THEN 'a'||chr(10)||chr(10)||'[^1]: n' ELSE 'a'||chr(10)||chr(10)||'## Links of '||n_name||chr(10)||chr(10)||'after'||chr(10)||chr(10)||'[^1]: n' END AS text FROM nation""")
def note_headings(spark, sf_dir):
    """The heading over the notes is taken as their title only if it is the page's last."""
    html = cat("<p>a</p><h2>Links of ", F.col("n_name"), '</h2><ol class="notes"><li>n</li></ol>', F.when(F.col("n_nationkey") % 2 == 1, "<p>after</p>").otherwise(""))
    markup = table(spark, sf_dir, "nation").select("n_nationkey", importer.import_page(html)["markup"].alias("m"))
    named = F.nullif(F.regexp_extract("m", r"(?m)^notes: (.*)$", 1), L(""))
    return markup.select("n_nationkey", named.alias("named"), F.regexp_replace(F.regexp_replace("m", r"(?s)\A---\n.*?\n---\n\n", ""), r"\n\z", "").alias("text"))


@register("track_notes", "E18 C26", """
SELECT n_nationkey, 'Hear[^mus.1] this, a line of prose which is long enough not to be verse at all.'||chr(10)||chr(10)||'[mus refs=mus glyph=¶]'||chr(10)||'[https://youtu.be/'||lpad(n_nationkey::VARCHAR,11,'a')||'|'||n_name||'|Band|1]'||chr(10)||'[/mus]' AS text FROM nation""")
def track_notes(spark, sf_dir):
    """A track that the text points at is the target of a note: its group, number and glyph come from the marker."""
    html = cat('<p>Hear<sup><a href="#mus-1">¶1</a></sup> this, a line of prose which is long enough not to be verse at all.</p><div class="track" id="mus-1" data-yt="', F.lpad(s("n_nationkey"), 11, "a"), '"><span class="t-name">', F.col("n_name"), '</span><span class="artist">Band</span></div>')
    markup = table(spark, sf_dir, "nation").select("n_nationkey", importer.import_page(html)["markup"].alias("m"))
    return markup.select("n_nationkey", F.regexp_replace(F.regexp_replace("m", r"(?s)\A---\n.*?\n---\n\n", ""), r"\n\z", "").alias("text"))


@register("missing_with_users", "E7 B13 D2 A9", """
SELECT DISTINCT l_partkey, l_suppkey AS used_by FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size<40)""")
def missing_with_users(spark, sf_dir):
    """What is used but not known, a row for each user, so a much used thing gathers nowhere."""
    known = table(spark, sf_dir, "part").filter("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("used_by")).distinct().join(known, "l_partkey", "left_anti")


@register("duplicate_keys", "F8", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1) SELECT DISTINCT l_orderkey, l_linenumber, n, l_partkey AS part FROM lineitem JOIN k USING(l_orderkey, l_linenumber)""")
def duplicate_keys(spark, sf_dir):
    """Keys that stand more than once, with their values, a row for each."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part")).agg(F.count("*").alias("c"))
    twice = rows.groupBy("l_orderkey", "l_linenumber").agg(F.sum("c").alias("n")).filter("n > 1")
    return rows.join(twice, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n", "part")


@register("playlist_steps", "G26 G1", """
SELECT p_partkey, lead(p_partkey) OVER w AS forward, lag(p_partkey) OVER w AS back, first_value(p_partkey) OVER w = p_partkey AS first FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_name, p_partkey)""")
def playlist_steps(spark, sf_dir):
    """A step to either neighbour inside a playlist, null at its ends."""
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_name", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.lead("p_partkey").over(w).alias("forward"), F.lag("p_partkey").over(w).alias("back"), (F.first("p_partkey").over(w) == F.col("p_partkey")).alias("first"))


@register("emphasis_words", "D9 J8", """
SELECT doc_id, len(list_filter(string_split(text,' '), lambda w: length(w)>=9))::BIGINT AS marked FROM documents""")
def emphasis_words(spark, sf_dir):
    """Long words put between underscores are italic candidates; the same marks inside words are none."""
    words = F.split("text", " ")
    marked = F.array_join(F.transform(words, lambda w: F.when(F.length(w) >= 9, F.concat(L(" _x_ "), L("a_b_c"))).otherwise("w")), " ")
    found = F.regexp_extract_all(marked, L(r"(?U)(?<![\w/])(_[^_\n]{1,60}_)(?!\w)"), L(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("marked"))
