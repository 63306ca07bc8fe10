"""Column functions: placement slots and Postgres-compatible scalars."""
