"""End-to-end flows and the registry of checked queries."""
