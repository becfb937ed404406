"""Temporal transaction-graph analytics as DataFrame operators."""
