"""Relational operators that maintain why-provenance."""
