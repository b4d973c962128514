"""Wiring of operators to the shared test tables, with SQL answers."""
