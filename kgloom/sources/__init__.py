"""Where graphs come from and go to."""
