"""Files that arrive over time, compared with those that are there."""
