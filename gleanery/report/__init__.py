"""Report formats: terminal text, JSON, CSV, SARIF, JUnit and HTML."""
