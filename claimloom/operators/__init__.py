"""DataFrame jobs, one module per stage of claim checking."""
