"""Where bars and settings come from and go to."""
