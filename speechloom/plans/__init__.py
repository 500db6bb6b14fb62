"""Whole runs: the stages in their order."""
