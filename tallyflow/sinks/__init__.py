"""Writers: files, tables, topics, changelogs."""
