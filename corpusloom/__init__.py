"""Text normalisation and corpus analytics on PySpark."""
