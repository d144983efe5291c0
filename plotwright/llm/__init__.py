"""Training-data pipeline operators. Nothing outside this package imports it, but for the guarded lookup in ``__spark_entry__.py``."""
