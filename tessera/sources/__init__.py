"""Reading files and tables into text units, and writing results."""
