"""strataq: a PySpark-native analytics engine for versioned, content-addressed extent metadata."""
