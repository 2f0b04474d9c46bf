"""Reading and writing tables, raw documents, rule files and review sheets."""
