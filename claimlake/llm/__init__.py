"""Operators that prepare text for training language models.

Nothing outside this package imports it; deleting the folder leaves the rest working.
"""
