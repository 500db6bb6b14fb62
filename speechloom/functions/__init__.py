"""Column-to-Column expression builders."""
