"""Training-data operators. Nothing outside this subpackage imports it."""
