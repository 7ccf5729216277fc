"""plantwire: Spark-native analysis of industrial-control network traffic.

Every operator takes DataFrames and returns a lazy DataFrame. Tables and their
columns are described in :mod:`plantwire.schemas`.
"""

__version__ = "0.1.0"
