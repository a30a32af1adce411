"""Operators for preparing training text: fingerprints, scoring, cleaning, sharding, encoding and mixing.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` list what ``__spark_entry__.py`` registers.
"""

from __future__ import annotations
