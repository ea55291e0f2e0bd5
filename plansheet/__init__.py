"""PySpark-native analytics over planar drawings."""
