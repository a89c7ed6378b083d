"""Binding of the operators to tables: views, registered queries and their SQL."""
