"""Turning analyses and edits into plans, and carrying plans over snapshots."""
