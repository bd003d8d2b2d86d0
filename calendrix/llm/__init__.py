"""Training-data operators: one module per operator, see catalog.py for the queries."""
