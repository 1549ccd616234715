"""annolith: a Spark-native engine for annotating feature profiles by vector search."""
