import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "millrace-tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def scripts(spark):
    """Build a script table from texts, numbered from 0."""

    def build(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "script_id bigint, sql_text string")

    return build
