"""COPY in its text, CSV and binary formats."""
