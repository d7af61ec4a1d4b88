"""Online forms of the trace patterns."""
