"""Training-data operators: scans, near-duplicate search, filtering, scoring and packing.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
