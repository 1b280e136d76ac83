"""Table functions over matches."""
