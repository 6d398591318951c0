"""Where events and pages come from."""
