"""Registered queries: each module here has QUERIES (name -> function of a session and a folder) and SQL (name -> equivalent text)."""
