"""Sources of quillspark."""
