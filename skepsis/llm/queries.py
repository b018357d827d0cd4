"""The registered queries of this folder: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, collocation, dialogue, gam, html, packing, quality, shards, simhash, tokenbin, toxic, urls
from .common import scratch_path, table

SHARDS = 16
QUERY_STRIDE = 100          # the contract's query set


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STRIDE == 0)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(html.sample(pages)), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("bigint"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash.components(table(spark, sf_dir, "documents"))
    return c.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs), ["doc_id"])


def op5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    tokenbin.write(table(spark, sf_dir, "documents"), path)
    return tokenbin.read(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.fit_table(urls.label_texts(pages)))


def op9_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxic.fit(*toxic.labelled(docs, table(spark, sf_dir, "labels")))
    return toxic.score(docs, model, ["doc_id"]).select("doc_id", toxic.held_out().alias("held_out"), "score", "predicted")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shards.shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    return s.select("doc_id", shards.byte_size().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                    F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repaired(table(spark, sf_dir, "conversations"))


def op13_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.fit(*gam.labelled(docs, table(spark, sf_dir, "labels")))
    return gam.score(docs, model, ["doc_id"]).select("doc_id", gam.held_out().alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann, "op2_html": op2_html, "op3_simhash": op3_simhash, "op4_quality": op4_quality, "op5_ids": op5_ids, "op6_bpe": op6_bpe, "op7_pack": op7_pack, "op8_urls": op8_urls, "op9_toxic": op9_toxic,
    "op10_shards": op10_shards, "op11_phrases": op11_phrases, "op12_dialogue": op12_dialogue, "op13_gam": op13_gam,
}
ORACLES: dict[str, str] = {"op11_phrases": collocation.ORACLE, "op12_dialogue": dialogue.ORACLE}
