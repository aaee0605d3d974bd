from __future__ import annotations

import __spark_entry__


def test_check_sql_is_text():
    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
