"""Reusable table operators, each ``DataFrame -> DataFrame`` and lazy.

The one action in here is the bounded size check behind every broadcast, see ``sizing``.
"""
