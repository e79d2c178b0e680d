"""Claim checking at corpus scale, written as Spark DataFrame jobs."""
