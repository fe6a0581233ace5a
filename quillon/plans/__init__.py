"""The four tools: checked arguments, a plan of operators, a response."""
