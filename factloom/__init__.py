"""A Spark-native engine for traceable numeric facts, their analytics and their graph."""
