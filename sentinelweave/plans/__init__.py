"""End-to-end compositions, derived views and the registered queries."""
