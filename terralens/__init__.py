"""terralens: a PySpark-native engine for fusing geolocated reports into evidence."""
