"""Queries of the training-data operators, by name, and their DuckDB oracles."""

from __future__ import annotations

from tessera.llm.decontaminate import OP1_SQL, op1_positional_index
from tessera.llm.html import OP8_SQL, op8_consensus_html
from tessera.llm.minhash import OP7_SQL, op7_chosen_path
from tessera.llm.mixing import OP10_SQL, op10_hash_threshold_mix
from tessera.llm.quality import op9_tokeniser_fertility
from tessera.llm.secrets import op3_crf_secrets
from tessera.llm.sharding import op5_best_fit_sharding
from tessera.llm.substring import OP4_SQL, op4_rabin_karp_windows
from tessera.llm.suffix import OP6_SQL, op6_interval_expansion
from tessera.llm.warc import OP2_SQL, op2_merkle_fixity

QUERIES = {
    "op1_positional_index": op1_positional_index,
    "op2_merkle_fixity": op2_merkle_fixity,
    "op3_crf_secrets": op3_crf_secrets,
    "op4_rabin_karp_windows": op4_rabin_karp_windows,
    "op5_best_fit_sharding": op5_best_fit_sharding,
    "op6_interval_expansion": op6_interval_expansion,
    "op7_chosen_path": op7_chosen_path,
    "op8_consensus_html": op8_consensus_html,
    "op9_tokeniser_fertility": op9_tokeniser_fertility,
    "op10_hash_threshold_mix": op10_hash_threshold_mix,
}

ORACLES: dict[str, str] = {
    "op1_positional_index": OP1_SQL,
    "op2_merkle_fixity": OP2_SQL,
    "op4_rabin_karp_windows": OP4_SQL,
    "op6_interval_expansion": OP6_SQL,
    "op7_chosen_path": OP7_SQL,
    "op8_consensus_html": OP8_SQL,
    "op10_hash_threshold_mix": OP10_SQL,
}
