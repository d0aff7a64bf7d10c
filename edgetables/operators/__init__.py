"""Table-in, table-out operators on edge tables, pair tables and run tables."""
