"""Registered queries: plans over the driver tables and their SQL."""
