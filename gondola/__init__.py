"""A Spark-native engine for retail price and demand intelligence."""
