"""PySpark-native document structuring and chunking."""
