"""Relations built from tables, and the queries over them."""
