"""Session-log analytics on Spark: read agent logs, clean them, match a lexicon, report."""

__version__ = "0.1.0"
