"""Operators for large training-data pipelines.

Every module here is self-contained: nothing outside this subpackage imports
it, and it imports nothing from the rest of the library.
"""
