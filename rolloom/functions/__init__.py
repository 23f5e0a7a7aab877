"""Column builders: scalar, text and token-array functions."""
