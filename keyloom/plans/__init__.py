"""plans of keyloom."""
