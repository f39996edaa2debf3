"""Whole jobs: the batch stages in order, and the queries bound to generic tables."""
