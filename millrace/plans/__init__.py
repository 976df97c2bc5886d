"""Ready-made jobs composed of the operators."""
