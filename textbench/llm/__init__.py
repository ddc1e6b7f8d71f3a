"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; its queries are added by
the driver contract only when it can be imported.
"""
