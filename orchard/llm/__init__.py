"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this subpackage; its queries are added by
``__spark_entry__.py`` when it is present.  See ``queries.py`` for the
registered queries and ``corpus_pipeline.py`` for the composed pipeline.
"""
