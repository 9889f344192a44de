"""vecloom: embedding, sample-set and corpus analytics written for Spark."""

__version__ = "0.1.0"
