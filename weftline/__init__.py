"""weftline: a Spark-native analytics engine for text and code style."""
