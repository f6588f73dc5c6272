"""Readers and writers for line-oriented, document and ledger inputs."""
