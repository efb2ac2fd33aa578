import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shelfmark.session import build_session

    session = build_session("tests", "local[8]")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inventory(spark):
    """Builds an inventory from (path, hash[, size, time, symlink]) rows."""
    from datetime import datetime

    def build(*rows):
        full = []
        for row in rows:
            path, digest, size, seconds, link = (*row, *(10, 0, False)[len(row) - 2:])
            full.append((path, size, digest, datetime.fromtimestamp(1_700_000_000 + seconds), link))
        return spark.createDataFrame(
            full, "path string, size_bytes bigint, hash string, modified_time timestamp, is_symlink boolean"
        )

    return build
