"""Scalar functions: token and k-gram hashes."""
