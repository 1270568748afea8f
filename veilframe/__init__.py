"""PySpark-native text pseudonymisation."""
