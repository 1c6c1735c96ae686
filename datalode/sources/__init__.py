"""Tables in shared folders: intermediate ones and raw copies."""
