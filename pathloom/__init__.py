"""pathloom: a PySpark-native engine for ordered movement and document data."""
