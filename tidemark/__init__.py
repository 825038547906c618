"""tidemark: Spark-native analytics for bar series and training-data tables."""
