"""Column functions: exact rounding, time differences, fingerprints."""
