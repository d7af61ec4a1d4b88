"""The queries of this subpackage: each applies one operator, with its parameters for production, to a whole table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrelspark.llm import exact_dedup, licenses, lloyd, minhash, packing, piece_bpe, prefix_trie, quality, repair, secrets, sharding, toxicity, vantage
from petrelspark.llm.columns import as_bytes, small_batches, texts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), "n_links")


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.minimax_shards(table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.adaptive_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = repair.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = piece_bpe.encoder(path)
        for batch in small_batches(batches, "text"):
            counts, of_ids, of_text = [], [], []
            for ids in code.encode_all(as_bytes(batch.column("text"))):
                full = np.concatenate([[code.begin], ids, [code.end]]).astype("<u4")
                counts.append(len(full))
                of_ids.append(hashlib.sha256(full.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(code.model.decode(full.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), hash_all=True)


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op11_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, factor=1.0)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), family=5, heads=9).drop("digest")


def op13_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dim=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_linking, op2_minimax_shards, op3_adaptive_quality, op4_repair_tokens, op5_ordinal_toxicity, op6_minhash_components, op7_license_rules, op8_piece_round_trip, op9_exact_dedup, op10_residual_packing, op11_vantage_neighbours, op12_conversation_trie, op13_lloyd_clusters)
}
