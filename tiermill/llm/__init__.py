"""Training-data pipeline operators (deduplication, decontamination, tokenization, archives, ...).

Nothing else in the library imports this subpackage; its queries are in ``tiermill.llm.queries``.
"""
