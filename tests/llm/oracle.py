"""The comparison with SQL, shared with the rest of the tests."""

from tests.oracle import TABLES, connect, same  # noqa: F401
