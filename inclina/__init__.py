"""Customer-propensity analytics written with the public Spark API."""
