"""Operators for preparing training data, each over whole tables.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries when it is there.
"""
