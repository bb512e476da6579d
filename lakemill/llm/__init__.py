"""Training-data operators: each works on a whole documents (or pages) table."""
