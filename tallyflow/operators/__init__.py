"""Relational operators: joins, aggregations, order-based operators, set operations."""
