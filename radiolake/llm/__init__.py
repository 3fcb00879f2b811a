"""Operators of a training-data pipeline over tables of texts, pages and conversations.

Nothing else in the library imports this subpackage.
"""
