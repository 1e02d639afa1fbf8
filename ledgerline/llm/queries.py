"""The registered queries of the corpus operators: each applies one operator,
with production parameters, to its whole table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import prepare
from ledgerline.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, seen by all executors."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.bpe import round_trip_digests
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.secret_scan import scan
    return scan(table(spark, sf_dir, "documents"), path_col="source")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.simhash_dedup import component_table
    return component_table(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import quality_forest as qf
    docs = table(spark, sf_dir, "documents")
    model = qf.fit_model(docs, table(spark, sf_dir, "labels"))
    return qf.judge(qf.statistics(docs), model)


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.bloom_lm import score_held_out
    return score_held_out(table(spark, sf_dir, "documents"))


def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.sanitise import span_table
    return span_table(table(spark, sf_dir, "documents"))


def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.line_blocks import extract_pages
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.substring_dedup import drop_repeats
    found = drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.decontaminate import find_leaks
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_repair_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import repair_output as ro
    path = shared_folder(spark, "token-shards")
    ro.write_shards(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return ro.decoded_documents(ro.read_shards(spark, path))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.piece_bpe import round_trip_digests
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.periodic_runs import run_table
    return run_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_secret_scan, op3_simhash_dedup, op4_quality_rules, op5_bloom_lm, op6_sanitise, op7_line_blocks, op8_substring_dedup,
                           op9_decontamination, op10_repair_output, op11_piece_bpe, op12_collocations, op13_periodic_runs)
}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        return run
    return {name: wrap(fn) for name, fn in QUERIES.items()}


def llm_oracles() -> dict[str, str]:
    from ledgerline.llm.collocations import ORACLE_SQL
    return {"op12_collocations": ORACLE_SQL}
