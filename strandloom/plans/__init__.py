"""Whole plans: the verbs, the command line, and the registered queries."""
