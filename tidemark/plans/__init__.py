"""Whole analyses made of operators, and the registered queries."""
