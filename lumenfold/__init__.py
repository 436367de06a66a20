"""PySpark-native photo-library analytics, with training-data operators in a removable subpackage."""
