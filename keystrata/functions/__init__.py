"""Column functions that the request language needs and Spark lacks."""
