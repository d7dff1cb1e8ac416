"""Plan building blocks that keep skewed groups spread over many tasks."""
