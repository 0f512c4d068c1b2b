"""Column functions: boxes, order-preserving keys."""
