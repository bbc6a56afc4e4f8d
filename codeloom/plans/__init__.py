"""Queries over the driver's tables; importing the package registers them all."""

from codeloom.plans import agent_queries, catalogue, focus_queries, report_queries, search_queries

__all__ = ["agent_queries", "catalogue", "focus_queries", "report_queries", "search_queries"]
