"""DataFrame -> DataFrame operators: quantile summaries, climatology, stations, wide files, charts."""
