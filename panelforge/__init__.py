"""panelforge: a PySpark-native analytics engine for panel, event and text data."""
