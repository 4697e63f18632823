"""The engine has no streaming operators: nothing of the kind belongs to its inventory. Logical tables are batch tables."""
