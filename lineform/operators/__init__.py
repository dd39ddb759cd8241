"""Operators over document, record and measurement frames."""
