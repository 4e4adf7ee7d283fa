"""A Spark-native analytics engine for competition results and similar star-shaped data."""
