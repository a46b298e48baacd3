"""Column functions: identities, text and rules."""
