"""Link discovery and site-graph analytics over crawl tables, on Spark DataFrames."""

__version__ = "0.1.0"
