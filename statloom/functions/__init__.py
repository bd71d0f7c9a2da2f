"""Special functions and distributions as Spark column expressions."""
