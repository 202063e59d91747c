"""Spark-native analytics over encoded columns that carry their own verified decoder."""
