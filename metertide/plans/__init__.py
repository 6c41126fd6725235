"""Plans: operators put together to the reports a user asks for."""
