"""Whole queries: the analysis run and the reports that read its output."""
