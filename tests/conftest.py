import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomery.session import local_session, release

    return local_session(4, "tests", "4g", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(autouse=True)
def _drop_intermediate_tables():
    from loomery.session import release

    yield
    release()
