"""Operators over bars: preparation, adjustment, factors, signals, backtests, ranking."""
