"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from loreforge.llm import bpe_tree, decontam, inner_products, main_text, private_data, secrets, sharding, simhash, token_files, toxicity

QUERIES = {
    "op1_toxicity_chain": toxicity.op1_toxicity_chain,
    "op2_token_files": token_files.op2_token_files,
    "op3_weak_supervision": private_data.op3_weak_supervision,
    "op4_norm_sorted_products": inner_products.op4_norm_sorted_products,
    "op5_credential_links": secrets.op5_credential_links,
    "op6_simhash_variants": simhash.op6_simhash_variants,
    "op7_stratified_shards": sharding.op7_stratified_shards,
    "op8_path_ratios": main_text.op8_path_ratios,
    "op9_prefix_decontamination": decontam.op9_prefix_decontamination,
    "op10_bpe_tree": bpe_tree.op10_bpe_tree,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_norm_sorted_products": inner_products.ORACLE_SQL,
    "op7_stratified_shards": sharding.ORACLE_SQL,
    "op9_prefix_decontamination": decontam.ORACLE_SQL,
}
