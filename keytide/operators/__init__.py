"""Pure DataFrame -> DataFrame operators over a changelog."""
