"""Technical indicators as DataFrame transformations."""
