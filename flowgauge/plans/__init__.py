"""Questions answered by combining several analyses in one plan."""
