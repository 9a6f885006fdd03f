"""Tallyline: who contributed what to software projects, as Spark jobs."""
