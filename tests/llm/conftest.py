import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """(folder, rows) of the awkward documents."""
    from cases import table

    folder = str(tmp_path_factory.mktemp("documents"))
    return folder, table(spark, folder)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """Empty tables."""
    from cases import table

    folder = str(tmp_path_factory.mktemp("nothing"))
    table(spark, folder, [], [])
    return folder
