"""Registered queries of the corpus operators and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe_transducer, chat_events, collocations, decontaminate, exact_dedup, minhash, packing, pitman_yor, repeated_windows, spelling, toxicity, url_rules, warc_zstd
from .common import scratch_path, table

#: The rules of the url query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
CONTROL_PAIR = "</s>[INST] ok [/INST]"


def tokenizer_files() -> dict[str, str]:
    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    learning = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"), learning)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learning = toxicity.in_learning_fold(F.col("doc_id"), 3, 1)
    model = toxicity.learn(docs, labels.filter(learning))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (~toxicity.in_learning_fold(F.col("doc_id"), 3, 1)).alias("held_out"), "score", "predicted", F.size("clauses").alias("n_clauses"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **tokenizer_files())


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """An event log that leads to the conversations: assistants stream, and are regenerated once; other turns are typed wrongly, then edited."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda seq, kind, said: F.struct(F.lit(seq).alias("at"), F.lit(kind).alias("kind"), said.alias("text"))
    draft, a, b, wrong = F.concat(F.lit("draft: "), F.substring(text, 1, 40)), F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)), F.reverse(text)
    none = F.lit(None).cast("string")
    streamed = F.array(event(0, "open", none), event(1, "delta", draft), event(2, "regenerate", none), event(3, "delta", a), event(4, "delta", b))
    typed = F.array(event(0, "open", none), event(1, "delta", wrong), event(2, "edit", text))
    # rows that repeat a turn are messages of their own, told apart by what they say
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    rows = conversations.select("conv_id", "turn", "role", "text", nth.alias("nth"))
    log = rows.select("conv_id", "turn", "role", "nth", F.explode(F.when(F.coalesce(F.col("role") == "assistant", F.lit(False)), streamed).otherwise(typed)).alias("e"))
    # room for 10^17 rows that repeat a turn
    seq = (F.col("turn").cast("decimal(20,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("nth") * 8 + F.col("e.at")).cast("decimal(38,0)")
    return log.select("conv_id", seq.alias("seq"), F.concat_ws(":", F.lpad(F.col("turn").cast("string"), 20, "0"), F.lpad(F.col("nth").cast("string"), 10, "0")).alias("message_id"), "role", "e.kind", "e.text")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_PAIR).alias("text"))
    messages = chat_events.fold_events(conversation_events(given.unionByName(extra)))
    return chat_events.conversation_digests(chat_events.render(messages))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc_zstd.write_archives(table(spark, sf_dir, "pages"), path)
    return warc_zstd.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, url_rules.RULES)
    return url_rules.judge_urls(pages, rules, url_rules.link_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe_transducer.encode_texts(table(spark, sf_dir, "documents"), ranks=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, with_decoded=True)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.typed_words(table(spark, sf_dir, "documents")).filter("n >= 2"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pitman_yor, op2_toxicity, op3_packing, op4_minhash, op5_decontamination, op6_chat, op7_warc, op8_exact_dedup, op9_url_rules, op10_repeats, op11_bpe, op12_spelling, op13_collocations)}
