"""A PySpark-native analytics engine for code and document graphs and the event logs around them."""
