"""Operators over relations: messaging, access, constraints, calendars, state changes."""
