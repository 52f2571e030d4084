import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from exselect.session import local_session

    session = local_session(4, "tests", "4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture
def small_broadcast(spark):
    """Makes the broadcast limit tiny, so that operators take their other way."""
    from exselect.session import BROADCAST_CONF

    def limit(size):
        spark.conf.set(BROADCAST_CONF, str(size))

    yield limit
    spark.conf.unset(BROADCAST_CONF)
