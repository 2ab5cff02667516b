"""Compositions of operators: the application's use cases."""
