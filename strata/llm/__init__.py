"""Training-data operators: each module holds one operator, `queries` registers them."""
