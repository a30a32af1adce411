"""From patterns to join plans, on the driver."""
