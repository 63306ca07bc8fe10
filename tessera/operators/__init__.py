"""Exact aggregates and orderings, join strategies, placement jobs, advice."""
