"""All queries of the reference's own operators."""

from corpuslens.plans import chat_graph_queries, peripheral_queries, relational_queries, system_queries, text_queries  # noqa: F401
from corpuslens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
