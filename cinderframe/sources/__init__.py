"""Tables and files that jobs read, and the scratch folder."""
