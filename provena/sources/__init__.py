"""Reading and writing of evidence files."""
