"""Complete runs built from the operators."""
