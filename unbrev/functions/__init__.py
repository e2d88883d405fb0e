"""Column builders: everything here takes and returns ``Column`` values."""
