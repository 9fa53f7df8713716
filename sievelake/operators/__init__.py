"""Relational and pipeline operators."""
