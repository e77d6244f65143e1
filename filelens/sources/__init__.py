"""Reading and writing inventories, artifacts, step logs and content."""
