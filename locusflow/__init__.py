"""locusflow: coordinate sorting and duplicate marking of aligned reads on Spark."""

__version__ = "0.1.0"
