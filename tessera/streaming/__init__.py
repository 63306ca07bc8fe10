"""Structured Streaming over placed tables: event-time counts, and change logs replayed into chunks."""
