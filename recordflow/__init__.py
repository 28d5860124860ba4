"""recordflow: record-oriented text and table analytics as DataFrame plans."""
