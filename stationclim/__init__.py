"""Spark-native weather-station climatology engine."""
