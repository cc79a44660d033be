"""Operators for preparing training text at scale.

Each module holds one operator with its own general interface; ``queries`` holds the thin
``opN_<name>`` queries and their SQL.  Nothing outside this package imports it.
"""
