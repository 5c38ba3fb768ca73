"""sparkloom: Spark-native analytics over text lines, edits, telemetry and file-symbol graphs."""
