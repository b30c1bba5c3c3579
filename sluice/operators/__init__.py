"""DataFrame forms of the stages."""
