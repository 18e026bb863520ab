"""Following growing files and reloading indicators."""
