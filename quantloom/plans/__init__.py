"""Declarative pipelines and the catalogue of queries."""
