"""keyloom: a PySpark-native analytics engine for ordered, keyed tables."""
