"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from strandline.llm import bpe_queue, chat_examples, close_vectors, count_filter, fill_in_middle, host_rules, language_tree, line_crf
from strandline.llm import near_copies, prefix_trie, secret_index, sequence_packing, sql, warc_derivatives


def queries() -> dict:
    return {
        "op1_host_rules": host_rules.op1_host_rules,
        "op2_near_copies": near_copies.op2_near_copies,
        "op3_line_crf": line_crf.op3_line_crf,
        "op4_language_tree": language_tree.op4_language_tree,
        "op5_sequence_packing": sequence_packing.op5_sequence_packing,
        "op6_count_filter": count_filter.op6_count_filter,
        "op7_chat_examples": chat_examples.op7_chat_examples,
        "op8_close_vectors": close_vectors.op8_close_vectors,
        "op9_bpe_round_trip": bpe_queue.op9_bpe_round_trip,
        "op10_warc_derivatives": warc_derivatives.op10_warc_derivatives,
        "op11_secret_index": secret_index.op11_secret_index,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict:
    return sql.ORACLE
