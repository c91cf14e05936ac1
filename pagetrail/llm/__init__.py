"""Training-data operators. Nothing outside this subpackage imports it; ``queries`` holds what it registers."""
