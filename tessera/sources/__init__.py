"""Where tables come from, and the versioned store that changes go to."""
