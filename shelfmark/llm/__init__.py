"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  ``registry`` maps query names to
functions of ``(spark, sf_dir)`` and holds the matching SQL.
"""
