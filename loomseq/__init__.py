"""Sequence-graph and allele analytics on Spark."""
