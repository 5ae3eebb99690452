"""A Spark-native engine for contiguity-constrained spatial regionalisation."""
