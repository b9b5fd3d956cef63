"""Rate-distortion evaluation of media methods as Spark DataFrame jobs."""

__version__ = "0.1.0"
