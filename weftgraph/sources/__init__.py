"""Tables, stores and file formats."""
