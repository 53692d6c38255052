"""Whole runs: profile, compare, report."""
