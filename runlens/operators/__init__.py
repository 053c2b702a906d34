"""runlens operators."""
