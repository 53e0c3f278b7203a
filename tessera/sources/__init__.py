"""Where graphs come from and go to: versioned table stores, document listings, tables derived for tests."""
