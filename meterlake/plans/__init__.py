"""The serving queries, composed of operators."""
