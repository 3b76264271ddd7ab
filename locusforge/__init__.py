"""A PySpark-native engine that annotates immune-receptor loci in genome assemblies."""
