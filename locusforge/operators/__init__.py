"""Distributed operators: fragments, scan, motif order, assembly."""
