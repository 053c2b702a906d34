"""runlens functions."""
