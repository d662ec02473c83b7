"""tessera: a Spark-native engine for key-unique columnar tables."""
