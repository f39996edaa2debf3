"""hydrolattice: crop-water analytics over gridded observation and weather tables, on Spark."""

__version__ = "0.1.0"
