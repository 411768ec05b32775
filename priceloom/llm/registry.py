"""Registered queries of the text operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from priceloom.llm import (
    mixing,
    order_minhash,
    packing,
    permutation,
    pitman_yor,
    shortest_pack,
    spelling,
    substrings,
    topk,
    toxicity,
    urls,
    value_dictionaries,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": pitman_yor.op1_pitman_yor,
    "op2_collinear_chaining": substrings.op2_collinear_chaining,
    "op3_seekable_warc": warc.op3_seekable_warc,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_toxicity_cnn": toxicity.op5_toxicity_cnn,
    "op6_permutation_index": permutation.op6_permutation_index,
    "op7_uniform_threshold": topk.op7_uniform_threshold,
    "op8_path_template_tree": urls.op8_path_template_tree,
    "op9_order_minhash": order_minhash.op9_order_minhash,
    "op10_entropy_balancing": mixing.op10_entropy_balancing,
    "op11_value_dictionaries": value_dictionaries.op11_value_dictionaries,
    "op12_permuterm_variants": spelling.op12_permuterm_variants,
    "op13_shortest_pack": shortest_pack.op13_shortest_pack,
}
CHECKS: dict[str, str] = {
    "op3_seekable_warc": warc.ORACLE,
    "op7_uniform_threshold": topk.ORACLE,
    "op11_value_dictionaries": value_dictionaries.ORACLE,
    "op12_permuterm_variants": spelling.ORACLE,
}
