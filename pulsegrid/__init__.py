"""A PySpark-native analytics engine for telemetry, labelled incidents and their evaluation."""
