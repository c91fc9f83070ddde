import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, shuffle_partitions=4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    """Files from ``(path, content)`` pairs or ``(scan, path, content)`` triples."""

    def make(*rows):
        full = [row if len(row) == 3 else ("s", *row) for row in rows]
        return spark.createDataFrame(full, "scan_id string, path string, content string")

    return make


@pytest.fixture
def scan(corpus):
    """Findings of some files as sorted rows."""
    from riskloom.operators.detect import detect

    def run(*rows, **options):
        found = detect(corpus(*rows), **options)
        return sorted(found.collect(), key=lambda r: (r.file_path, r.line_number, r.rule_ordinal, r.pos))

    return run
