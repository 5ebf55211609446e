"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, decontaminate, fim, htmltext, license_scan, phrases, quality_knn, quality_rules, simhash, tokenbin, urlfilter, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_chat_collapse": chat.op1_chat_collapse,
    "op2_warc_archive": warc.op2_warc_archive,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_html_main_text": htmltext.op4_html_main_text,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_token_id_files": tokenbin.op6_token_id_files,
    "op7_quality_classifier": quality_knn.op7_quality_classifier,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_quality_llr": quality_rules.op9_quality_llr,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_url_filter": urlfilter.op12_url_filter,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
}

ORACLES = {
    "op1_chat_collapse": chat.OP1_SQL,
    "op2_warc_archive": warc.OP2_SQL,
    "op9_quality_llr": quality_rules.OP9_SQL,
    "op10_benchmark_decontamination": decontaminate.OP10_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op12_url_filter": urlfilter.OP12_SQL,
    "op13_phrase_collocations": phrases.OP13_SQL,
}
