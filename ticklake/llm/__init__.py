"""Operators of a training-data pipeline over documents, pages, embeddings and conversations.

Nothing outside this package imports it. ``load`` hands out its queries and their SQL.
"""


def load():
    """Import the query module; return (queries, sql)."""
    from ticklake.llm import queries

    return queries.QUERIES, queries.SQL
