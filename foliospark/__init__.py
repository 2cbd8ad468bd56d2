"""Document analytics on Spark: ingest, classify, extract, check, store and measure business documents."""

__version__ = "0.1.0"
