"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from metricloom.llm import decontam, langid, licenses, lm_score, mixing, revisits, secrets, simhash, spotsigs, toxicity

QUERIES = {
    "op1_lattice_score": lm_score.op1_lattice_score,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_language_id": langid.op5_language_id,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_revisit_resolution": revisits.op7_revisit_resolution,
    "op8_spot_signatures": spotsigs.op8_spot_signatures,
    "op9_toxicity_chain": toxicity.op9_toxicity_chain,
    "op10_secret_scan": secrets.op10_secret_scan,
}
ORACLE_SQL: dict[str, str] = {"op7_revisit_resolution": revisits.OP7_SQL}
