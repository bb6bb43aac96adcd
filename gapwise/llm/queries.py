"""The registered queries of this folder: one per operator."""

from gapwise.llm import bpe, decontaminate, dialogue, html, jaccard, langid, lm, negatives, pii, quality, sharding, simhash, suffix

QUERIES = {
    "op1_simhash_dedup": simhash.query,
    "op2_decontaminate": decontaminate.query,
    "op3_suffix_dedup": suffix.query,
    "op4_quality": quality.query,
    "op5_pii": pii.query,
    "op6_bpe": bpe.query,
    "op7_langid": langid.query,
    "op8_sharding": sharding.query,
    "op9_lm_score": lm.query,
    "op10_html_extract": html.query,
    "op11_jaccard_join": jaccard.query,
    "op12_hard_negatives": negatives.query,
    "op13_dialogue_repair": dialogue.query,
}
ORACLES: dict[str, str] = {
    "op11_jaccard_join": jaccard.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_dialogue_repair": dialogue.ORACLE,
}
