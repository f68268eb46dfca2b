"""Composed jobs: round loop, supervised jobs, registered queries and oracles."""
