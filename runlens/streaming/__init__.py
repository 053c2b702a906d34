"""runlens streaming."""
