"""Column functions on sequences and loci, and their SQL registration."""
