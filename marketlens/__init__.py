"""A Spark-native engine for market text: pages to typed, checked and summarised tables."""
