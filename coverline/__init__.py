"""coverline: a PySpark-native engine for semi-structured insurance-benefit data."""
