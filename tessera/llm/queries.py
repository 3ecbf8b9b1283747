"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import bpe, decontaminate, langid, pii, quality, secrets, simhash, substring, toxicity, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_quality": quality.op2_quality,
    "op3_warc": warc.op3_warc,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_pii": pii.op5_pii,
    "op6_bpe": bpe.op6_bpe,
    "op7_langid": langid.op7_langid,
    "op8_substring": substring.op8_substring,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES: dict[str, str] = {"op3_warc": warc.SQL, "op4_decontamination": decontaminate.SQL, "op8_substring": substring.SQL}
