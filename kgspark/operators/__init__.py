"""Jobs on graph tables."""
