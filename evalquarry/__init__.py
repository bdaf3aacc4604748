"""PySpark-native analytics over language-model evaluation records."""
