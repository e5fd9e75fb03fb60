"""Floor-plan style graph analytics as DataFrame and SQL queries."""
