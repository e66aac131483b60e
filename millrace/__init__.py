"""millrace: Spark-native preparation of language-model training corpora."""
