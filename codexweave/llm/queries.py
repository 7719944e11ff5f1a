"""The pN_ queries of the text operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexweave.llm import corpus_tokens, encodings, leakage, lookalikes, repeated_lines, scan_noise, splitting, text_stats
from codexweave.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, sf_dir, "pages"), table(spark, sf_dir, "job_status"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, sf_dir, "pages"), table(spark, sf_dir, "job_status"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "job_key", "book", "page_number", "printed_page", "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.noise(_scanned(spark, sf_dir))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired(_scanned(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.same_look(table(spark, sf_dir, "pages"))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.forms(table(spark, sf_dir, "pages")).select("page_id", "form")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_classes(table(spark, sf_dir, "pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.wrongly_decoded(spread(table(spark, sf_dir, "pages").select("page_id", "text")))


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.repaired(table(spark, sf_dir, "pages"))


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, sf_dir, name) for name in ("pages", "chunks", "job_status", "split_limits"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(*_items(spark, sf_dir))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(*_items(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_tokens.corpus_ids(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_tokens.decoded(p7_ids(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.structured(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.document_statistics(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_clean, p3_found, p3_repaired, p4_found, p4_canonical, p4_classes, p5_found, p5_restored, p6_found, p6_pieces, p7_ids, p7_decoded, p8_found, p8_shares, p9_found, p9_statistics)}


def oracle_sql() -> dict[str, str]:
    from codexweave.llm.sql import ORACLES

    return dict(ORACLES)
