"""Whole pipelines: annotation, reports, output files."""
