"""Drift checks over arriving batches."""
