"""Part of the deductive engine."""
