"""Routing and explanation of statements over Catalyst's plans."""
