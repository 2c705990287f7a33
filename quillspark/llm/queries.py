"""The registered queries of the training-data operators: op1 to op10 over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import read


def _in_layouts(records: DataFrame) -> DataFrame:
    """The conversations as records of several layouts, by conv_id; each holds the same turns.

    Lists of role and content, of role and text, and of nested author and parts; a first system turn beside
    the list; prompt and response where a user's turn and an assistant's are all.
    """
    messages, kind = F.col("messages"), F.pmod(F.col("conv_id"), F.lit(5))
    roles = F.transform(messages, lambda t: t["role"])
    pair, led = roles == F.array(F.lit("user"), F.lit("assistant")), F.get(roles, F.lit(0)) == "system"
    text = lambda i: F.get(messages, F.lit(i))["content"]
    as_text = F.transform(messages, lambda t: F.struct(t["role"].alias("role"), F.lit(None).cast("string").alias("content"), t["content"].alias("text")))
    plain = lambda m: F.transform(m, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), F.lit(None).cast("string").alias("text")))
    parts = F.transform(messages, lambda t: F.struct(F.struct(t["role"].alias("role")).alias("author"), F.struct(F.array(t["content"]).alias("parts")).alias("content")))
    layout = F.when((kind == 1) & pair, "pair").when((kind == 2) & led, "led").when(kind == 3, "parts").when(kind == 4, "text").otherwise("list")
    known = records.withColumn("layout_", layout)
    is_ = lambda name: F.col("layout_") == name
    return known.select(
        "conv_id",
        F.when(is_("list"), plain(messages)).when(is_("text"), as_text).when(is_("led"), plain(F.slice(messages, F.lit(2), F.size(messages)))).alias("messages"),
        F.when(is_("led"), text(0)).alias("system"),
        F.when(is_("pair"), text(0)).alias("prompt"),
        F.when(is_("pair"), text(1)).alias("response"),
        F.when(is_("parts"), parts).alias("mapping"),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import chat

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = F.lit("</s>[INST] ok [/INST]")
    turns = F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role")) for t, r in enumerate(("user", "assistant")))))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), turns.alias("t")).select("conv_id", "t.turn", "t.role", tricky.alias("text"))
    records = _in_layouts(chat.conversations_as_records(rows.unionByName(extra)))
    done = chat.format_chat(records, records.columns[1:])
    back = done.select("conv_id", "formatted", "loss", chat.parse_turns(F.col("formatted")).alias("back"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss", lambda s: chat.unescape(F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    found = back.select("conv_id", F.size("back").cast("long").alias("n_turns"), said.alias("said"), lost.alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"))
    return found.select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.merkle import against_edits

    return against_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.bpe import encode

    coded = encode(read(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.bpe import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.substring import remove_repeats

    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), window=35, joined=True)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.packing import best_fit

    return best_fit(read(spark, sf_dir, "documents"), "byte_bpe_50k.json", 2048)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import crf

    docs = read(spark, sf_dir, "documents")
    model = crf.train(docs, read(spark, sf_dir, "labels"))
    scored = crf.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", crf.held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= crf.PREDICT_FROM).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import rules

    judged = rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [F.col(f"{rules.HELD}.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed, kept = F.col("__verdict.base_failed"), F.col("__verdict.kept")
    return judged.select("doc_id", *counts, failed.alias("base_failed"), (~failed & kept).alias("kept"), F.col("__verdict.good").alias("good_probability"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.licenses import scan

    return scan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_document_fingerprints": op2_document_fingerprints,
        "op3_bpe_encode_decode": op3_bpe_encode_decode,
        "op4_token_counts": op4_token_counts,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_quality_rules": op9_quality_rules,
        "op10_license_scans": op10_license_scans,
    }


#: op1 and op6 as SQL; the other operators train, tokenise, iterate or hash as SQL can't.
OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + len(regexp_extract_all(role, '<[|\\\\]')) + length(text) + len(regexp_extract_all(text, '<[|\\\\]')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 35)) AS j FROM r)),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
k AS (SELECT p.doc_id, count(c.p) AS n_removed, string_agg(x, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op6_substring_dedup": OP6_SQL}
