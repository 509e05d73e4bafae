"""quire: a Spark-native analytics engine for document evidence."""
