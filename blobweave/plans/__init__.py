"""Whole queries: feature vectors, and the registry of checked queries."""
