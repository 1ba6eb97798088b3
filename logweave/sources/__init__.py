"""Table sources (fixture rendering, parquet tables) and sinks."""
