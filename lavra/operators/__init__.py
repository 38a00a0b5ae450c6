"""DataFrame operators: frame in, frame out, no collect inside."""
