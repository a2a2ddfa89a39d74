"""The queries of the corpus operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from causeway.llm import bag_minhash, itemset_phrases, language_id, lattice_lm, line_quality, line_runs, merkle, mixing, piece_sampling, quartile_digest, repeats, sharding, token_frames


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lattice_lm": lattice_lm.op1_lattice_lm,
        "op2_token_frames": token_frames.op2_token_frames,
        "op3_language_id": language_id.op3_language_id,
        "op4_repeats": repeats.op4_repeats,
        "op5_sharding": sharding.op5_sharding,
        "op6_fingerprints": quartile_digest.op6_fingerprints,
        "op7_bag_minhash": bag_minhash.op7_bag_minhash,
        "op8_mixing": mixing.op8_mixing,
        "op9_line_quality": line_quality.op9_line_quality,
        "op10_pieces": piece_sampling.op10_pieces,
        "op11_itemset_phrases": itemset_phrases.op11_itemset_phrases,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_line_runs": line_runs.op13_line_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_repeats": repeats.ORACLE,
        "op5_sharding": sharding.oracle(),
        "op7_bag_minhash": bag_minhash.ORACLE,
        "op8_mixing": mixing.ORACLE,
        "op9_line_quality": line_quality.ORACLE,
        "op11_itemset_phrases": itemset_phrases.ORACLE,
        "op12_merkle_manifest": merkle.oracle(),
        "op13_line_runs": line_runs.ORACLE,
    }
