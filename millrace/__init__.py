"""millrace: a PySpark-native retrieval, graph and memory analytics engine."""
