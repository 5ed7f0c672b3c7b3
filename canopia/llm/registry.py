"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from canopia.llm import decontaminate, langid, linededup, manifest, mixing, neighbours, passages, pii, quality, rules, secrets, simhash, trie

QUERIES = {
    "op1_learned_partitions": neighbours.query,
    "op2_compact_windows": passages.query,
    "op3_quality_subwords": quality.query,
    "op4_line_dedup": linededup.query,
    "op5_bootstrapped_pii": pii.query,
    "op6_decontamination": decontaminate.query,
    "op7_hierarchical_mixing": mixing.query,
    "op8_simhash_pigeonhole": simhash.query,
    "op9_hierarchical_langid": langid.query,
    "op10_assignment_secrets": secrets.query,
    "op11_conversation_trie": trie.query,
    "op12_isolation_rules": rules.query,
    "op13_merkle_manifest": manifest.query,
}
ORACLES = {
    "op4_line_dedup": linededup.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op7_hierarchical_mixing": mixing.ORACLE,
    "op11_conversation_trie": trie.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
