"""Operators for large training-data pipelines (text, pages, conversations).

Nothing else in the library imports this package; ``__spark_entry__.py`` adds
its queries only when it is present.
"""
