"""DataFrame-to-DataFrame operators with column-name parameters."""
