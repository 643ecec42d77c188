"""Training-data operators: one module each, plus ``queries`` for the driver."""
