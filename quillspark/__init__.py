"""Analytics for document-text recognition and text-line detection on PySpark."""
