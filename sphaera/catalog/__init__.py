"""The engine's operators as queries over balls and atoms derived from the driver's tables."""
