"""Incremental indicators on streams of bars."""
