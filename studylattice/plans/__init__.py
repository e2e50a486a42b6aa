"""Plan shapes that keep hot groups spread over many tasks."""
