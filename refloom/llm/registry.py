"""The queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from . import bpe, chat, htmlcrf, packing, pll, quality, simhash, spotsigs, suffix, urls

QUERIES = {
    "op1_suffix_dedup": suffix.suffix_dedup,
    "op2_bpe": bpe.bpe,
    "op3_html_text": htmlcrf.html_text,
    "op4_spot_fingerprints": spotsigs.spot_fingerprints,
    "op5_quality_rules": quality.quality_rules,
    "op6_chat_format": chat.chat_format,
    "op7_simhash_dedup": simhash.simhash_dedup,
    "op8_packing": packing.packing,
    "op9_url_filter": urls.url_filter,
    "op10_lm_scores": pll.lm_scores,
}
SQL = {"op6_chat_format": chat.SQL, "op9_url_filter": urls.SQL}
