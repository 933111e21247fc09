"""From file contents to imports and declarations."""
