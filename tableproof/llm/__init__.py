"""Training-data operators: each module holds one operator, registry.py the queries built on them."""
