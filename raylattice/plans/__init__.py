"""The query catalogue: each query with its SQL twin where SQL can state it."""
