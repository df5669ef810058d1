"""auralith: a Spark-native catalog, analysis and similarity engine for collections of short recordings."""

__version__ = "0.1.0"
