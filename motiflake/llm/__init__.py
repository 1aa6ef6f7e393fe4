"""Operators for preparing training text. Nothing outside this folder imports them but ``__spark_entry__.py``
and ``corpus_pipeline.py``; the queries and their SQL are in :mod:`motiflake.llm.queries`."""
