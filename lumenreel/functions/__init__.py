"""Column expressions: scalar rules over metrics, time, text and URLs."""
