"""Registered queries: each binds operators to tables and names its SQL twin."""
