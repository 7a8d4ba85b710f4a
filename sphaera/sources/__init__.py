"""Tables that operators read."""
