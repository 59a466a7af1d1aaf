"""Reading and writing tables, chunks and fitted parameters."""
