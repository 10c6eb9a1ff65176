"""tilewright: a PySpark-native spatial-tile analytics engine."""
