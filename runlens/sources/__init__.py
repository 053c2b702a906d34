"""runlens sources."""
