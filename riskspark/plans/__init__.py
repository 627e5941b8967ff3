"""Registered queries, oracle SQL and end-to-end plans."""
