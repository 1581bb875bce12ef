"""The registered queries of this subpackage and their SQL."""

from . import decontaminate, html, imatch, language, packing, phrases, pii, quality, sharding, simhash, spelling, substrings, tokens

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_language": language.op2_language,
    "op3_tokens": tokens.op3_tokens,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality": quality.op5_quality,
    "op6_html": html.op6_html,
    "op7_simhash": simhash.op7_simhash,
    "op8_packing": packing.op8_packing,
    "op9_pii": pii.op9_pii,
    "op10_sharding": sharding.op10_sharding,
    "op11_spelling": spelling.op11_spelling,
    "op12_imatch": imatch.op12_imatch,
    "op13_phrases": phrases.op13_phrases,
}
ORACLE_SQL = {"op4_decontaminate": decontaminate.OP4_SQL, "op5_quality": quality.oracle_sql(), "op12_imatch": imatch.oracle_sql(), "op13_phrases": phrases.oracle_sql()}
