"""Bars and other inputs from tables and vendor files."""
