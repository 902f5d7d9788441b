"""Command formats: syntax, declared value types, programs, and the languages these describe."""
