"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from logloom.llm.chat_format import OP6_SQL, op6_chat_format
from logloom.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from logloom.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from logloom.llm.metric_search import OP5_SQL, op5_exact_top_k
from logloom.llm.near_dups import OP8_SQL, op8_minhash_near_dups
from logloom.llm.packing import op4_best_fit_packing
from logloom.llm.quality_rules import OP2_SQL, op2_quality_rules
from logloom.llm.source_mixing import op10_source_mixing
from logloom.llm.substring_dedup import OP3_SQL, op3_suffix_array_dedup
from logloom.llm.token_counts import op13_token_counts
from logloom.llm.toxicity import op9_toxicity
from logloom.llm.url_filter import OP1_SQL, op1_url_filter
from logloom.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_chat_format": op6_chat_format,
    "op7_warc": op7_warc,
    "op8_minhash_near_dups": op8_minhash_near_dups,
    "op9_toxicity": op9_toxicity,
    "op10_source_mixing": op10_source_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}
SQL = {
    "op1_url_filter": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op3_suffix_array_dedup": OP3_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op8_minhash_near_dups": OP8_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
