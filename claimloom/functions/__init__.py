"""Column builders: each takes and returns a Spark Column."""
