"""Operators that prepare text corpora for training; nothing outside this folder imports them."""
