"""Compositions of the operators: research jobs, the query catalog and the
SQL oracles used to check it."""
