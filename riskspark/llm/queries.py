"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from riskspark.llm import attention_lm, decontaminate, fingerprints, html_wrapper, line_dedup, near_dedup, packing, passage_dedup, quality, spelling, toxicity, turn_repair, warc
from riskspark.llm.common import table


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return passage_dedup.removed_units(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark, sf_dir):
    return attention_lm.query(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark, sf_dir):
    return turn_repair.query(table(spark, sf_dir, "conversations"))


def op13_html_extraction(spark, sf_dir):
    return html_wrapper.main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_fingerprints": op6_fingerprints,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_spelling": op11_spelling,
    "op12_turn_repair": op12_turn_repair,
    "op13_html_extraction": op13_html_extraction,
}
ORACLE = {
    "op1_near_dedup": near_dedup.SQL,
    "op2_substring_dedup": passage_dedup.oracle(),
    "op3_decontamination": decontaminate.oracle(),
    "op9_line_dedup": line_dedup.SQL,
    "op11_spelling": spelling.SQL,
    "op12_turn_repair": turn_repair.SQL,
    "op13_html_extraction": html_wrapper.SQL,
}
