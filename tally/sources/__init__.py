"""Reading feeds, writing tables, and describing both."""
