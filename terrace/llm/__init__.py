"""Training-data operators: deduplication, decontamination, scoring, extraction, mixing and formatting of text corpora.

Nothing outside this package imports it; ``terrace.llm.queries`` lists its queries and their SQL.
"""
