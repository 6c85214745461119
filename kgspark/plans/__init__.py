"""Domain tables and registered queries."""
