"""Streaming views over the step log."""
