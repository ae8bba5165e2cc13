"""Operators for training data. Nothing outside this subpackage imports it."""

#: Modules with QUERIES and SQL.
MODULES = ["skarn.llm.event_queries", "skarn.llm.record_queries", "skarn.llm.corpus_queries", "skarn.llm.abuse_queries"]
