"""Column functions: rounding, lenient casts, calendar labels, machine health."""
