"""Document-intelligence operators as PySpark DataFrame jobs."""
