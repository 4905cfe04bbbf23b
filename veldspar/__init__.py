"""veldspar: analytics over text and Gaussian vectors, written as PySpark plans."""
