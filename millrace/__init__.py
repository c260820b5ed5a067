"""millrace: a PySpark-native engine for the data side of language-model post-training."""
