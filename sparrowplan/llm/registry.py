"""The queries of the corpus operators, and their SQL where there is any."""

from sparrowplan.llm import bpe, decontamination, jaccard_join, language_id, line_dedup, lm_scoring, sharding, token_counts, topk_search, toxicity

MODULES = [language_id, line_dedup, sharding, token_counts, topk_search, bpe, lm_scoring, jaccard_join, toxicity, decontamination]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
