"""Graph operators: expansion and degrees, vector search, subgraphs, and what runs to a fixed point."""
