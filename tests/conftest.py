from __future__ import annotations

import pytest

from stellate.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests",
        cores=8,
        spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("checkpoints")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    yield session
    session.stop()


def rows_of(df):
    """Rows as a sorted list of tuples in column order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
