"""Operators for preparing language-model training data.

Nothing outside this package imports it; the registry in ``__spark_entry__`` adds its
queries only when it is present.
"""
