"""Text segmentation and corpus analytics on PySpark."""
