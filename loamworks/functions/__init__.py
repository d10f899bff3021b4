"""Column builders: text rules, formats, verdicts, costs."""
