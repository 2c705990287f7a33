"""Chat, fingerprints, rules, classifier, license scans, pipeline and the registered queries."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import chat, crf, licenses, merkle, queries as q, rules
from quillspark.llm.license_templates import TEMPLATES

SF = "/root/testdata/sf0.001"


def test_layouts_are_known_by_fingerprint(spark):
    rows = spark.createDataFrame(
        [(1, "a", "b", None, None, None), (2, None, None, "do", "in", "out"), (3, None, None, "do", None, "out"), (4, "zz", None, None, None, None)],
        "id int, prompt string, response string, instruction string, input string, output string",
    )
    got = {r.id: r for r in chat.format_chat(rows, rows.columns[1:]).collect()}
    assert [got[i].layout for i in (1, 2, 3, 4)] == ["prompt_response", "instruction_input_output", "instruction_output", None]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "do\n\nin"), ("assistant", "out")]
    assert got[4].turns is None and got[4].formatted is None
    lists = spark.createDataFrame([(1, [("human", "h"), ("gpt", None)]), (2, []), (3, None)], "id int, conversations array<struct<from:string,value:string>>")
    got = {r.id: r for r in chat.format_chat(lists, ["conversations"]).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "h"), ("assistant", "")] and got[2].formatted == "" and got[3].layout is None


def test_layouts_that_share_a_table(spark):
    kind = "id int, messages array<struct<role:string,content:string,text:string,name:string,weight:int>>, data struct<prompt:string,response:string>"
    rows = [
        (1, [("user", "a", None, None, None), ("assistant", "b", None, "n", 1)], None),
        (2, [("user", None, "c", None, None), ("assistant", None, None, None, 0)], None),
        (3, None, ("p", "r")),
        (4, [("user", "a", "c", None, None)], None),
        (5, [("user", None, None, None, None)], None),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r.id: r for r in chat.format_chat(df, df.columns[1:]).collect()}
    assert [got[i].layout for i in range(1, 5)] == ["messages", "messages_text", "data_prompt_response", None]
    turns = {i: [(t.role, t.text) for t in got[i].turns] for i in (1, 2, 3, 5)}
    assert turns == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "c"), ("assistant", "")], 3: [("user", "p"), ("assistant", "r")], 5: [("user", "")]}


def test_nested_paths_and_taken_names(spark):
    kind = "id int, mapping array<struct<author:struct<role:string>,content:struct<parts:array<string>>>>, turns int, layout string, formatted int, loss int, fingerprint int"
    rows = [
        (1, [(("user",), (["a", "b"],)), (("Human",), ([None],))], 7, "x", 8, 9, 10),
        (2, [(None, None), (("user",), None)], None, None, None, None, None),
        (3, [], None, None, None, None, None),
        (4, None, None, None, None, None, None),
    ]
    got = {r.id: r for r in chat.format_chat(spark.createDataFrame(rows, kind), ["mapping"]).collect()}
    assert (got[1].turns, got[1].layout, got[1].formatted, got[1].loss, got[1].fingerprint) == (7, "x", 8, 9, 10)
    assert [(t.role, t.text) for t in got[1].turns_] == [("user", "a\n\nb"), ("Human", "")]
    assert [(t.role, t.text) for t in got[2].turns_] == [("", ""), ("user", "")]
    assert got[1].layout_ == got[2].layout_ == "mapping_parts" and got[3].turns_ == [] and got[4].layout_ is None


def test_a_very_long_turn(spark):
    rows = [(1, [("user", "<|" * 300_000), ("assistant", "x" * 1_000_000)])]
    r = chat.format_chat(spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>"), ["messages"]).first()
    assert len(r.formatted) > 1_900_000 and r.loss[0].length == 1_000_000


def test_any_text_comes_back(spark):
    rng = random.Random(2)
    bits = ["<", "|", "\\", "<|turn|>", "<|end|>\n", "<|text|>", "x", "</s>", "\n", "é🙂", "$1"]
    rows = [(i, [(r, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for r in ("user", "assistant", "we|<rd")]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")
    done = chat.format_chat(df, ["messages"]).select("id", "formatted", "loss", chat.parse_turns(F.col("formatted")).alias("back"))
    for r in done.collect():
        assert [(t.role, t.text) for t in r.back] == rows[r.id][1]
        lost = "".join(re.sub(r"<\\(?=[|\\])", "<", r.formatted[s.start : s.start + s.length]) for s in r.loss)
        assert lost == rows[r.id][1][1][1]


def test_merkle_equality_edits_and_order(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "a\nx\nc"), (4, None), (5, ""), (6, "\n".join(f"line {i}." for i in range(40)))]
    fp = {r.doc_id: r.fingerprint for r in merkle.fingerprint_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert fp[1] == fp[2] != fp[3] and fp[4] == fp[5]
    pair = spark.createDataFrame([(fp[1], fp[3]), (fp[6], fp[6])], "a string, b string")
    got = pair.select(merkle.differing_paragraphs(F.col("a"), F.col("b")), merkle.likeness(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == [1] and abs(got[0][1] - 2 / 3) < 1e-9 and got[1][0] == [] and got[1][1] == 1.0


def tree(text):
    """The fingerprint in plain Python: branches and leaves."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = [sha(p) for p in text.split("\n")]
    groups = [digests[i : i + merkle.SECTION] for i in range(0, len(digests), merkle.SECTION)]
    sections = [sha("".join(g)) for g in groups]
    leaves = [x for p in text.split("\n") for x in re.findall(r"[^.!?]{0,31}[.!?]+|[^.!?]{1,32}", p)]
    hashed = [f"{xxhash.xxh64_intdigest(x.encode(), 42) >> 32:08x}" for x in leaves]
    upper = [sha("".join(sections))[:32], ",".join(s[:8] for s in sections), "/".join("".join(d[:8] for d in g) for g in groups)]
    return ";".join([*upper, "".join(hashed)]), hashed


def tree_likeness(a, b):
    if a == b:
        return 1.0
    x, y = tree(a)[1], tree(b)[1]
    places = 2 * sum(p == q for p, q in zip(x, y)) / max(len(x) + len(y), 1)
    return max(places, 2 * len(set(x) & set(y)) / max(len(set(x)) + len(set(y)), 1))


_LINES = [f"Line {i} of a text, not long. Is it? Yes! " * (i % 4) for i in range(60)]
_EDITED = [
    [(5, "abcdefgh"), (2, "xyz"), (None, "null id text"), (9, None), (9, "dup"), (9, "pud"), (9, "dup"), (40, "ü" * 9)],
    [(3, "only one.")],
    [(3, "twice"), (3, "twice")],
    [],
    [(i, "\n".join(_LINES[i : i + i * 3 % 41])) for i in range(30)] + [(31, "no line feed in it. " * 4000), (32, "\n\n\n"), (33, "a\n" * 3000)],
]


@pytest.mark.parametrize("rows", _EDITED)
def test_edited_texts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("need", F.lit("clash"))
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), signed(r[1])))
    want = []
    for k, (i, t) in enumerate(order):
        after, n = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        row = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), tree(t)[0], tree(edited)[0], tree_likeness(t, edited), tree_likeness(t, after))
        want += [row] * sum((j, s or "") == (i, t) for j, s in rows)
    got = [tuple(r) for r in merkle.against_edits(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(again)


def test_rule_counts_and_edges(spark):
    texts = [None, "", " \n\t", "one", "a b c d e\na b c d e\n\na b c d e", "é# $ü|\v<x>\x1cq", "z " * 5000, "A\nA \nA"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", None)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        c = got[i][rules.HELD]
        assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words) == brute_counts(t)
    assert len(got) == len(texts) + 1
    assert rules.judge(docs.filter("false")).count() == 0 and rules.keep_good(docs.filter("false")).columns == docs.columns


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(6000) < 0.8
    accuracy, abstain = np.array([0.95, 0.9, 0.75, 0.85]), 0.2
    right = rng.random((6000, 4)) < accuracy
    votes = np.where(right == truth[:, None], rules.GOOD, rules.BAD)
    votes[rng.random((6000, 4)) < abstain] = rules.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = rules.estimate(patterns, counts.astype(float), list("abcd"))
    assert abs(model.prior - 0.8) < 0.05
    for k, name in enumerate("abcd"):
        assert all(abs(a - accuracy[k]) < 0.06 for a in model.accuracy(name))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 4, 8])
    unary, pair = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    good, moves = crf.marginals(unary, pair, first)
    total = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        z, p, m = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2 ** (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            s = np.exp(sum(unary[a + i, y[i]] for i in range(b - a)) + sum(pair[y[i - 1], y[i]] for i in range(1, b - a)))
            z += s
            p += s * np.array(y)
            for i in range(1, b - a):
                m[y[i - 1], y[i]] += s
        if b > a:
            assert np.allclose(good[a:b], p / z)
            total += m / z
    assert np.allclose(moves, total)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in q.op8_quality_classifier(spark, sf).collect()]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right >= 0.93 * len(held)


def test_every_line_of_a_long_training_document_counts(spark):
    lines = [f"Line {i} is a good line with several words." if i % 2 else f"## {i} !! $$ **" for i in range(2000)]
    docs = spark.createDataFrame([(i, "\n".join(lines[: 2000 - i] if i else lines)) for i in range(3)] + [(7, "bad $$ ## !!")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    taken = {r.doc_id for r in labels.filter(~crf.held_out()).collect()}
    sizes = []
    own = crf.fit

    def fit(features, length, first, label):
        sizes.extend(np.diff(first).tolist())
        return own(features, length, first, label, rounds=2)

    crf.fit = fit
    try:
        crf.train(docs, labels)
    finally:
        crf.fit = own
    assert sorted(sizes) == sorted({0: 2000, 1: 1999, 2: 1998, 7: 1}[i] for i in taken)
    assert crf.runs_of(np.array([0, 0, 300, 301]), 128).tolist() == [0, 128, 256, 300, 301]


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", None), (None, "good line here.\nmore of it.", 0.0), (4, "x!! " * 9000, 1.0)], "doc_id long, text string, __score double")
    labels = spark.createDataFrame([(4, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = crf.train(docs, labels)
    got = {r.doc_id: r["__score"] for r in crf.score(docs, model).collect()}
    assert len(got) == 4 and got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert crf.score(docs.filter("false"), model).count() == 0
    crf.train(docs.filter("false"), labels)


def test_license_spans(spark):
    mit = TEMPLATES["mit-permission"].replace("free of charge", "at no cost").replace("sublicense, ", "")
    rows = [(1, f"é {mit} y"), (2, None), (3, ""), (None, "Released under the MIT License."), (5, "under the MIT sun"), (6, "x " * 9000 + TEMPLATES["gpl-3.0-statement"] + " z " + TEMPLATES["mit-statement"])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))).collect()
    text = dict(rows)
    assert sorted(((r.doc_id or 0), r.license) for r in got) == [(0, "mit-statement"), (1, "mit-permission"), (6, "gpl-3.0-statement"), (6, "mit-statement")]
    one = next(r for r in got if r.doc_id == 1)
    assert 0.9 < one.coverage < 1 and text[1][one.start_char : one.end_char] == mit.rstrip(".")
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}).count() == 0


def test_every_copy_of_a_short_statement_is_found(spark):
    short = ["mit-statement", "apache-2.0-statement", "cc-by-nc-4.0-statement", "gpl-3.0-statement"]
    rows, want = [], []
    for name in short:
        words = TEMPLATES[name].split()
        for n in (1, 2, 3, 7):
            rows.append((len(rows), " ".join([TEMPLATES[name]] * n)))
            want.append((name, n))
        changed = " ".join([*words[: len(words) // 2], "zzz", *words[len(words) // 2 + 1 :]])
        for text, n in ((changed, 1), (f"{TEMPLATES[name]} {changed} {TEMPLATES[name]}", 3), (f"{changed} {changed}", 2)):
            rows.append((len(rows), text))
            want.append((name, n))
    got = [[] for _ in rows]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append(r)
    for found, (name, n), (_, text) in zip(got, want, rows):
        assert [r.license for r in found] == [name] * n, text


def whole_alignment(template, words):
    """The most template words that any local alignment of the best score matches, without a band."""
    best = (0, 0)
    above = [(0, 0)] * (len(words) + 1)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(words):
            s, m = above[j]
            cell = max((s + 2, m + 1) if t == w else (s - 1, m), (above[j + 1][0] - 1, above[j + 1][1]), (row[-1][0] - 1, row[-1][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1])
        above = row
    return best


def test_banded_alignment_equals_the_whole_one(spark):
    rng = random.Random(8)
    rows, want = [], []
    for k in range(60):
        name = rng.choice(list(TEMPLATES))
        template = licenses.fold(TEMPLATES[name].encode()).split()
        words = [w.decode() for w in template]
        for _ in range(rng.randint(0, len(words) // 12)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["zz"], [words[at], "yy"]])
        text = " ".join(f"p{rng.randrange(99)}" for _ in range(rng.randint(0, 30)))
        text = f"{text} {' '.join(words)} q"
        rows.append((k, text))
        matched = whole_alignment(template, licenses.fold(text.encode()).split())[1]
        want.append((name, matched) if matched >= licenses.LEAST * len(template) else None)
    found = {k: [] for k, _ in rows}
    for name in TEMPLATES:  # each template by itself, so no other takes its place
        for r in licenses.scan(spark.createDataFrame([x for x, w in zip(rows, want) if w and w[0] == name], "doc_id int, text string"), {name: TEMPLATES[name]}).collect():
            found[r.doc_id].append((r.license, r.matched_words))
    assert sum(w is not None for w in want) > 40
    for (k, _), w in zip(rows, want):
        assert w is None or found[k] == [w]


def test_many_copies_and_prose_near_long_templates(spark):
    rng = random.Random(2)
    many = " ".join([TEMPLATES["mit-permission"]] * 40)
    prose = " ".join(rng.choice("the of software this or use a in and to any copyright notice conditions zebra apple river".split()) for _ in range(20_000))
    got = licenses.scan(spark.createDataFrame([(1, many), (2, prose)], "doc_id int, text string")).collect()
    assert [r.license for r in got if r.doc_id == 1] == ["mit-permission"] * 40
    ends = sorted((r.start_char, r.end_char) for r in got if r.doc_id == 1)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "own.txt").write_text("You may use this text as you like, but name its author in every copy of it.")
    got = licenses.scan(spark.createDataFrame([(1, "x You may use this text as you like, but name its author in each copy of it. y")], "doc_id int, text string"), licenses.templates_of(str(tmp_path)))
    assert [(r.license, r.matched_words) for r in got.collect()] == [("own", 16)]


def test_every_statement_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sum(sum(r.text.count(TEMPLATES[n]) for n in TEMPLATES if n.endswith("statement")) for r in docs.collect())
    assert licenses.scan(docs).count() == want


def test_registered_queries_run(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    found = q.queries()
    assert [k.split("_")[0] for k in found] == [f"op{i}" for i in range(1, 11)]
    for name in ("op2", "op3", "op4", "op5", "op6", "op8", "op9"):
        run = next(f for k, f in found.items() if k.startswith(name + "_"))
        assert run(spark, SF).count() == n
    rows = {r.conv_id: r for r in found["op1_chat_formatting"](spark, SF).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and rows[-1].loss_chars == len(said)


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in out}
    assert kept <= {r.doc_id for r in docs.collect()} and len(cp.STAGES) == 5
    good = [i for i in labels if labels[i] == 1]
    assert sum(i in kept for i in good) >= 0.8 * len(good)  # copies go, clean documents stay
    assert not [i for i in labels if labels[i] == 0 and i in kept][2:]


def test_the_query_meets_several_layouts(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    records = q._in_layouts(chat.conversations_as_records(rows))
    found = {r.layout for r in chat.canonical(records, records.columns[1:]).select("layout").distinct().collect()}
    assert None not in found and len(found) >= 4


def test_only_the_last_stage_files_stay(spark):
    import os

    import corpus_pipeline as cp
    from quillspark.llm.common import shared_folder

    base = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(base))
    cp.run(spark, SF)
    (new,) = [x for x in set(os.listdir(base)) - before if x.startswith("pipeline-")]
    assert [x for x in os.listdir(f"{base}/{new}") if not x.startswith(".")] == ["3-substring_dedup"]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace as Fake

    from quillspark.llm.common import shared_folder

    unset = Fake(sc=lambda: Fake(getCheckpointDir=lambda: Fake(isEmpty=lambda: True)))
    with pytest.raises(ValueError):
        shared_folder(Fake(sparkContext=Fake(_jsc=unset, master="spark://host:7077"), conf=Fake(get=lambda name, default: default)))


def test_stages_files_have_small_row_groups(spark, tmp_path):
    import corpus_pipeline as cp
    import pyarrow.parquet as pq

    def largest(name: str) -> int:
        docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
        cp.quality_rules(spark, docs, "/root/testdata/sf0.1").coalesce(1).write.parquet(str(tmp_path / name))
        (file,) = (tmp_path / name).glob("*.parquet")
        found = pq.ParquetFile(file).metadata
        return max(found.row_group(k).total_byte_size for k in range(found.num_row_groups))

    spark.conf.unset("parquet.block.size")
    try:
        assert largest("own") < 8 << 20
        spark.conf.set("parquet.block.size", str(64 << 20))
        assert largest("given") > 8 << 20
    finally:
        spark.conf.unset("parquet.block.size")


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, __t int, __rid string, tile int"
    words = " ".join(f"Wort{i}" for i in range(60))
    rows = [
        (1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, 1, "r", 2), (None, f"Ein Satz. {words}.", "de", "s", 9, None, None, None), (3, f"Noch ein Satz. {words}.", "de", None, 9, 1, "x", 1),
        (3, f"Noch ein Satz. {words}.", "de", None, 9, 1, "x", 1), (4, "Das ist gut.\n" * 3000, "de", "s", 39000, 0, "", 0), (5, "The end of it is here and there.", "en", "s", 32, 3, "y", 3),
    ]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    for docs in (odd, odd.filter("false")):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n <= docs.count() or name == "best_fit_packing"
            if name == "substring_dedup":
                assert n == docs.count()
            if name != "best_fit_packing":
                assert set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
    kept = cp.near_dedup(spark, odd, SF).select("doc_id").collect()
    assert sorted((r.doc_id or 0) for r in kept).count(3) <= 1


def test_conversation_rows_in_any_order(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a"), (None, None, None, None), (1, 1, "assistant", None), (2, None, "user", "x"), (2, 0, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.format_chat(chat.conversations_as_records(df), ["messages"]).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a"), ("assistant", ""), ("assistant", "")]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "x"), ("", "y")] and len(got[None].turns) == 1
    assert chat.format_chat(chat.conversations_as_records(df.filter("false")), ["messages"]).count() == 0


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_oracle_sql(spark, name):
    from tests.compare import compare

    assert compare(spark, SF, q.queries()[name], q.oracle_sql()[name]) is None
