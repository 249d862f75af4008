"""Tidemark: event and market-microstructure analytics expressed as Spark plans."""
