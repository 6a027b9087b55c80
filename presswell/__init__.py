"""presswell: Spark-native analytics for news and messaging-channel content."""
