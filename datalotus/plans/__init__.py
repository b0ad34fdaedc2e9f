"""Whole-table runs: profile, report, narrative, charts and the command line."""
