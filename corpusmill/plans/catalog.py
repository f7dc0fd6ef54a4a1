"""Every registered query, by area."""

from corpusmill.plans import corpus_queries, language_queries, profile_queries, statistics_queries, table_queries  # noqa: F401
