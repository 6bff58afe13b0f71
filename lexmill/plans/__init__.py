"""Query registry and the equivalent SQL."""
