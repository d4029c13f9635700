"""branchlight: a PySpark engine that grows, labels and searches trees over content embeddings."""
