"""Sources: binary dumps, armored text, logs, pages, spool folders."""
