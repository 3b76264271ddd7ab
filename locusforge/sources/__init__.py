"""Readers of FASTA, configuration and motif tables."""
