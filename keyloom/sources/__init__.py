"""Tables, op-logs and file formats."""
