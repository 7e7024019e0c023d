"""Part of deedloom."""
