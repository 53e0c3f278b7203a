"""Check plans: planning rules, the contract they must meet, and their revisions."""
