"""arcweave: a Spark-native engine for directed graphs held in ordinary tables."""
