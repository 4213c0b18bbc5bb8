"""The registered queries and the adapters they read."""
