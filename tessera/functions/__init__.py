"""Part of the tessera document analytics library."""
