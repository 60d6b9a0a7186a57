"""Plans that keep global or per-key order without one big partition."""
