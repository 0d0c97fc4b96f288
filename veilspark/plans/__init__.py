"""What to look for: the declared recognisers."""
