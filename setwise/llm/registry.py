"""The training-data queries and their SQL, by name."""

import corpus_pipeline
from setwise.llm import bpe, language, licenses, line_spread, mixing, quality, simhash, toxicity, warc, webp


def queries() -> dict:
    return {
        "op1_mix_to_weights": mixing.op1,
        "op2_warc_chunks": warc.op2,
        "op3_toxicity_bigru": toxicity.op3,
        "op4_line_frequency": quality.op4,
        "op5_language": language.op5,
        "op6_line_spread": line_spread.op6,
        "op7_bpe": bpe.op7,
        "op8_webp": webp.op8,
        "op9_simhash": simhash.op9,
        "op10_license_rules": licenses.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_chunks": warc.ORACLE, "op4_line_frequency": quality.ORACLE, "op6_line_spread": line_spread.ORACLE}
