"""Column functions: text clean-up and time arithmetic without a time zone."""
