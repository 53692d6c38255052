"""Reading and writing tables, profiles and reports."""
