"""geneloom: gene-cluster comparison as Spark DataFrames."""

__version__ = "0.1.0"
