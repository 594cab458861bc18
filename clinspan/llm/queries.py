"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from . import conversation_trie, fingerprints, html_text, license_scan, mixing, mpeg_ts, packing, ranked_search, secret_scan, simhash, token_counts, toxicity, warc

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_mpeg_ts": mpeg_ts.query,
    "op3_mixing": mixing.query,
    "op4_toxicity": toxicity.query,
    "op5_license_scan": license_scan.query,
    "op6_fingerprints": fingerprints.query,
    "op7_simhash": simhash.query,
    "op8_warc": warc.query,
    "op9_secret_scan": secret_scan.query,
    "op10_packing": packing.query,
    "op11_html_text": html_text.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_ranked_search": ranked_search.query,
}
