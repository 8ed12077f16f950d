"""Ready-made analytics built from the operators."""
