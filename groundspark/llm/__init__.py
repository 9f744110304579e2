"""Training-data operators: one module each; ``queries`` registers them."""
