"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Each module holds one operator with its own interface; ``queries`` registers the
digest queries and ``oracle`` their SQL where SQL can express them.
"""
