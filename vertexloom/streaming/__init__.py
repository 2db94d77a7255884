"""Result files applied as they arrive."""
