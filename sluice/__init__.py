"""A PySpark-native engine for declarative, incrementally maintained data pipelines."""
