"""Relational operators on episodes, windows, statistics, samples and batches."""
