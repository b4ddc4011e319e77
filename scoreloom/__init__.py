"""scoreloom: a PySpark-native engine for scoring structured-document extraction."""
