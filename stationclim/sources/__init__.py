"""Scans: raw / merged observations, station list, wide files, output CSVs, test views."""
