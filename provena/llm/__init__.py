"""Operators for preparing training data at corpus scale; nothing outside this folder imports them."""
