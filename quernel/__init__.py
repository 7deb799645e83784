"""quernel: a Spark-native, read-only analytical SQL engine with data-preparation operators."""
