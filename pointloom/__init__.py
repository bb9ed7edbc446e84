"""pointloom: a Spark-native store and query engine for sequences of 3-D point-cloud frames."""
