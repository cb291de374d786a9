"""skyloom: a PySpark-native engine for multilingual news and document streams."""
