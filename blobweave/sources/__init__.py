"""Reading masks and profiles, writing feature tables."""
