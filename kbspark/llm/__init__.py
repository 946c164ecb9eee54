"""Operations of a training-data pipeline: the ten operators, their queries and SQL.

Nothing outside this subpackage imports it, apart from the guarded import in
``__spark_entry__.py`` and the stages of ``corpus_pipeline.py``.
"""
