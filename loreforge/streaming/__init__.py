"""Structured Streaming forms of the learner's state and of activity counts."""
