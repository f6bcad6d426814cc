"""wordmill: a Spark-native engine for preparing text and speech corpora."""
