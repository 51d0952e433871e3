"""placeweave: a PySpark-native place-intelligence analytics engine."""
