"""Tables, key-value views over multi-version data, and sinks."""
