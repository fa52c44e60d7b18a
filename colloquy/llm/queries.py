"""The queries pN_... over the test tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import bpe_tree, cuts, fmindex, pairs, pieces, pii, quantiles, swap_sample, vptree, winnow
from colloquy.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.link_dialogues(table(spark, folder, "dialogues")).pairs()


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.link_dialogues(table(spark, folder, "dialogues")).groups().withColumnRenamed("key", "rec_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.items(table(spark, folder, "dialogues"))


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(table(spark, folder, "dialogues"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pii.counts_against(table(spark, folder, "dialogues"), table(spark, folder, "clean_results"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return swap_sample.unmet_targets(table(spark, folder, "dialogues"), table(spark, folder, "sample_targets"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return swap_sample.target_report(table(spark, folder, "dialogues"), table(spark, folder, "sample_targets"))


def p3_needs(spark: SparkSession, folder: str) -> DataFrame:
    """What each target needs and what there is, from the report."""
    return p3_report(spark, folder).select("plan_id", "target_id", "available", "needed", "cannot_be_met", "floor_kept")


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return swap_sample.draw_samples(table(spark, folder, "dialogues"), table(spark, folder, "sample_targets"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn rows counted anew."""
    return swap_sample.drawn_counts(table(spark, folder, "dialogues"), table(spark, folder, "sample_targets"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defective_sides(table(spark, folder, "preference_pairs"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Defects per side, and which sign tells of truncated ones."""
    return pairs.defect_report(table(spark, folder, "preference_pairs"))


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.request_percentiles(quantiles.request_sketches(table(spark, folder, "raw_1")))


def p5_days_combined(spark: SparkSession, folder: str) -> DataFrame:
    days = quantiles.combine_days(quantiles.request_sketches(table(spark, folder, "raw_1")))
    return quantiles.request_percentiles(days).drop("grouping", "run_day", "client_key")


def p5_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The sketches as they are stored."""
    return quantiles.describe(quantiles.request_sketches(table(spark, folder, "raw_1")))


def p5_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the stated error holds for every percentile, by counting all rows."""
    rows = table(spark, folder, "raw_1")
    return quantiles.bounds_kept(rows, quantiles.request_sketches(rows))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.overlap_pairs(table(spark, folder, "dialogues"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.overlap_report(table(spark, folder, "dialogues"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The report's counts."""
    return p6_report(spark, folder).drop("mean_coverage")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return cuts.cut_results(table(spark, folder, "results")).where("cut").select("result_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return cuts.cut_report(table(spark, folder, "results"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_tree.encode_documents(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return fmindex.leaked_pairs(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return fmindex.removal_spans(fmindex.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


def p9_word_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The removal spans by words."""
    return p9_spans(spark, folder).select("doc_id", "first_word", "end_word")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_documents(table(spark, folder, "documents")).where("n_pieces > 1 and piece_idx = 0").select("doc_id")


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_documents(table(spark, folder, "documents"))


def p10_promises(spark: SparkSession, folder: str) -> DataFrame:
    """Per document whether its pieces keep the limit and the overlap and cover the text without a gap."""
    documents = table(spark, folder, "documents")
    return pieces.promises_kept(pieces.split_documents(documents), documents)


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
