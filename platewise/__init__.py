"""Platewise: a PySpark-native engine for item analytics, recommendation and planning."""
