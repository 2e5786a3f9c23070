"""Adapters from the test tables to the market model, and the registered queries with their SQL."""
