"""Writers for the merged table, per-station CSV / JSON outputs and the GeoJSON layer."""
