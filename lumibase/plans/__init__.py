"""Pipelines made of the operators, and the queries that are registered for them."""
