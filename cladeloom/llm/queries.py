"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from . import bin_packing, collocations, decontaminate, language_model, license_scan, line_dedup, matroska, packing, prefix_trie, quality, simhash, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_license_scan": license_scan.query,
    "op3_packing": packing.query,
    "op4_quality": quality.query,
    "op5_language_model": language_model.query,
    "op6_simhash": simhash.query,
    "op7_line_dedup": line_dedup.query,
    "op8_media": matroska.query,
    "op9_warc": warc.query,
    "op10_decontaminate": decontaminate.query,
    "op11_bin_packing": bin_packing.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_collocations": collocations.query,
}

SQL = {
    "op2_license_scan": license_scan.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_warc": warc.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_collocations": collocations.SQL,
}
