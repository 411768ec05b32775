"""Column functions and the helpers that keep jobs safe at scale."""
