"""Training-data operators. Nothing outside this subpackage (and its queries) imports it."""
