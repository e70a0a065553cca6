"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ballmeans, langid, licenses, mixing, neardup, packing, quality, spelling, suffixtree, tokenbin, toxicity, vafile, warc

QUERIES = {
    "op1_language": langid.op1_language,
    "op2_quality": quality.op2_quality,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_token_files": tokenbin.op4_token_files,
    "op5_suffix_tree": suffixtree.op5_suffix_tree,
    "op6_top_k": vafile.op6_top_k,
    "op7_packing": packing.op7_packing,
    "op8_licenses": licenses.op8_licenses,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_spelling": spelling.op12_spelling,
    "op13_ball_means": ballmeans.op13_ball_means,
}
ORACLE_SQL = {"op6_top_k": vafile.OP6_SQL, "op10_mixing": mixing.OP10_SQL, "op12_spelling": spelling.OP12_SQL, "op13_ball_means": ballmeans.OP13_SQL}
