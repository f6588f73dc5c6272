"""Registered queries: each module has QUERIES (name -> callable) and ORACLES (name -> SQL)."""
