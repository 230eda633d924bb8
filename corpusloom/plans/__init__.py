"""The queries over the engine's operators."""
