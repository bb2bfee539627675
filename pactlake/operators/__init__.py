"""What can be done with a contract: check, profile, compare, infer, diff, export."""
