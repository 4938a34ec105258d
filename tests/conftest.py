import pytest

from scriptloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "6g")
    yield session
    session.stop()


@pytest.fixture
def scripts(spark):
    """Turn texts into a `scripts` frame with ids 0, 1, 2 .."""

    def make(*texts):
        rows = [(str(i), text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "script_id string, source string")

    return make


@pytest.fixture
def codes():
    """The code column of chunk rows per script id, in chunk order."""

    def collect(df, number="chunk_no"):
        out = {}
        for row in sorted(df.collect(), key=lambda r: (r.script_id, r[number])):
            out.setdefault(row.script_id, []).append(row.code)
        return out

    return collect
