"""Operators on DataFrames: sessions, cooldown, votes, tracks, duplicates, splits, statistics, evaluation."""
