"""Column builders: every function takes and returns columns, nothing is evaluated on the driver."""
