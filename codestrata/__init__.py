"""A Spark-native engine that makes the architecture of Go code queryable and its rules enforceable."""
