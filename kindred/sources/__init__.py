"""CSV tables of strings, reports, and the command line."""
