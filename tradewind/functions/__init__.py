"""Small Column helpers shared by operators and plans."""
