"""Registry of this folder's queries and of their SQL twins (where SQL can express one)."""

from __future__ import annotations

from tagwarden.llm.bond_negatives import op11_bond_scan
from tagwarden.llm.bpe_matrix import op5_bpe_matrix
from tagwarden.llm.extendible_dedup import op13_extendible_hash
from tagwarden.llm.external_shuffle import op10_external_shuffle
from tagwarden.llm.language_id import op2_language_mixture
from tagwarden.llm import bond_negatives, extendible_dedup, length_buckets, quality_rules, warc_segments
from tagwarden.llm.length_buckets import op1_length_buckets
from tagwarden.llm.periodic_runs import op12_periodic_runs
from tagwarden.llm.phrase_fingerprint import op4_phrase_fingerprint
from tagwarden.llm.pii_semicrf import op8_pii_semicrf
from tagwarden.llm.quality_rules import op6_quality_rules
from tagwarden.llm.simhash_bk import op9_simhash_bktree
from tagwarden.llm.toxicity_chain import op3_toxicity_chain
from tagwarden.llm.warc_segments import op7_warc_segments

QUERIES = {
    "op1_length_buckets": op1_length_buckets,
    "op2_language_mixture": op2_language_mixture,
    "op3_toxicity_chain": op3_toxicity_chain,
    "op4_phrase_fingerprint": op4_phrase_fingerprint,
    "op5_bpe_matrix": op5_bpe_matrix,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc_segments": op7_warc_segments,
    "op8_pii_semicrf": op8_pii_semicrf,
    "op9_simhash_bktree": op9_simhash_bktree,
    "op10_external_shuffle": op10_external_shuffle,
    "op11_bond_scan": op11_bond_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_extendible_hash": op13_extendible_hash,
}
ORACLE: dict[str, str] = {
    "op1_length_buckets": length_buckets.oracle(),
    "op6_quality_rules": quality_rules.oracle(),
    "op7_warc_segments": warc_segments.oracle(),
    "op11_bond_scan": bond_negatives.oracle(),
    "op13_extendible_hash": extendible_dedup.oracle(),
}
