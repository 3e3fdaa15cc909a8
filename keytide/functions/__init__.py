"""Schema, validation and key-predicate helpers; everything here builds Columns or plain values."""
