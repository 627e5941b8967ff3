"""Learner-risk analytics on Spark."""
