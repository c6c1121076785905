"""PySpark-native research engine for cross-sections of daily (or resampled) price panels."""
