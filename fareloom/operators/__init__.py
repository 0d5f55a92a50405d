"""DataFrame operators of the trip warehouse."""
