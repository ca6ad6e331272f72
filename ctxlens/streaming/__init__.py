"""The same accounting and session counting over an arriving request log."""
