"""Operators of a training-data pipeline over tables of documents and web pages.

Nothing else in the library imports this subpackage. Operators that use Python
inside tasks need the package on the workers (``pyproject.toml``).
"""
