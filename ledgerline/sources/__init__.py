"""Reading transaction files, matching their headers, and writing results."""
