"""Files and tables as graphs, and results as files."""
