"""Part of the quillgraph engine."""
