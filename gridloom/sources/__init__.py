"""Where images come from and go to."""
