"""Quireframe: analytics over page-structured documents and their records, as PySpark DataFrame jobs."""
