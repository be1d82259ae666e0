"""Stand-in views and the registered queries built from the operators."""
