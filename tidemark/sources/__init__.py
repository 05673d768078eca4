"""Where ledger relations come from, and where they go."""
