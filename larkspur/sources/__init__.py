"""Where tables come from, and how they are written."""
