"""ledgerlark: a PySpark-native analytics engine for commerce and review-governance data."""
