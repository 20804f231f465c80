"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, clusters, embeddings, infill, licenses, mixing, mixing_lm, pii, quality, secrets, sharding, simhash, warc

_MODULES = {
    "op1_jump_sharding": sharding,
    "op2_quality_sketches": quality,
    "op3_pii_weak_supervision": pii,
    "op4_pareto_mix": mixing,
    "op5_bpe_tree": bpe,
    "op6_context_mixing": mixing_lm,
    "op7_warc_revisits": warc,
    "op8_secret_battery": secrets,
    "op9_pivot_permutations": embeddings,
    "op10_simhash_pivots": simhash,
    "op11_annulus_clusters": clusters,
    "op12_fill_in_middle": infill,
    "op13_rare_token_licenses": licenses,
}

QUERIES = {name: getattr(module, name) for name, module in _MODULES.items()}

ORACLES = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
