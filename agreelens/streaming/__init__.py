"""Structured Streaming forms of the evaluation and of the annotation state."""
