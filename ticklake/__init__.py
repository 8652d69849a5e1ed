"""ticklake: market tick ingest, candles, reads and pipeline metrics on Spark."""
