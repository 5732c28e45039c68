"""Training-data operators (dedup, language, quality, secrets, encoding, ...).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
when it is present.  ``registry.queries()`` and ``registry.oracle_sql()`` list
the ``opN_*`` queries.
"""
