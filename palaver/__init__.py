"""palaver: a Spark-native conversation memory and analytics engine."""
